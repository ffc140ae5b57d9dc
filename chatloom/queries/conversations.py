"""Queries over ``conversations``: turns, cards, catalog statistics."""

from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import cards, catalog, clusters, conversations as C
from chatloom.queries.base import Tables, query

PART = 4000  # small parts, so that the split itself is checked

_SQL_TURNS = """
turns AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE
      CASE WHEN length(sq) > 1200 THEN left(sq, 1200) || ' …[truncated]' ELSE sq END END AS body
  FROM (SELECT *, regexp_replace(regexp_replace(text, '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') AS sq
        FROM conversations WHERE role IN ('user', 'assistant', 'tool') AND text <> '')
)"""


def turns(t: Tables):
    rows = t.conversations.select(
        "conv_id", F.col("turn").alias("pos"), "role", F.lit("text").alias("content_type"), "text"
    )
    return C.turns(rows)


def heads(t: Tables):
    """Conversation headers; the first turn stands in for the title."""
    first = t.conversations.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("f"), F.max("turn").alias("last"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("last").cast("int")), "yyyy-MM-dd")
    return first.select(
        "conv_id", F.col("f.text").alias("title"), F.col("last").cast("double").alias("create_time"),
        day.alias("create_date"), day.alias("update_date"),
    )


_SQL_HEADS = """
heads AS (
  SELECT conv_id, first(text ORDER BY turn) AS title, max(turn)::DOUBLE AS create_time,
    strftime(DATE '2024-01-01' + max(turn)::INTEGER, '%Y-%m-%d') AS create_date
  FROM conversations GROUP BY conv_id
)"""
_KEBAB = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    f"""WITH {_SQL_TURNS}
    SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user_turns,
      count(*) FILTER (role = 'assistant') AS n_assistant_turns, count(*) FILTER (role = 'tool') AS n_tool_turns,
      sum(length('[' || role || '] ' || body) + 2)::BIGINT - 2 AS transcript_chars
    FROM turns GROUP BY conv_id"""
)
def conversation_cards(t: Tables):
    """Flagship: one card per conversation, with the size of its reduced transcript."""
    rows = turns(t)
    size = rows.groupBy("conv_id").agg((F.sum(F.length("block") + 2) - 2).cast("bigint").alias("transcript_chars"))
    return (
        cards.signals(rows)
        .join(size, "conv_id")
        .select("conv_id", "n_turns", "n_user_turns", "n_assistant_turns", "n_tool_turns", "transcript_chars")
        .orderBy(F.desc("n_turns"), "conv_id")
    )


@query(
    """SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user_turns,
      count(*) FILTER (role = 'assistant') AS n_assistant_turns, count(*) FILTER (role = 'tool') AS n_tool_turns,
      bool_or(contains(text, '```'))::BIGINT AS has_code,
      bool_or(contains(text, '[image]') OR contains(text, '[asset]') OR contains(lower(text), '[dalle'))::BIGINT AS has_image_asset,
      0::BIGINT AS has_browsing, 0::BIGINT AS has_reasoning, 0::BIGINT AS has_execution_output
    FROM conversations WHERE role IN ('user', 'assistant', 'tool') AND text <> '' GROUP BY conv_id"""
)
def card_signals(t: Tables):
    out = cards.signals(turns(t))
    return out.select(*[F.col(c).cast("bigint").alias(c) if c.startswith("has_") else F.col(c) for c in out.columns])


@query(
    f"""WITH {_SQL_TURNS},
    placed AS (
      SELECT *, '[' || role || '] ' || body AS block,
        coalesce(sum(length('[' || role || '] ' || body) + 2) OVER (
          PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM turns)
    SELECT conv_id, (before // {PART})::BIGINT AS part_no, count(*) AS n,
      string_agg(block, E'\\n\\n' ORDER BY turn) AS text
    FROM placed GROUP BY conv_id, before // {PART}"""
)
def card_transcript(t: Tables):
    """Reduced transcripts in bounded parts."""
    return C.transcripts(turns(t), PART)


@query(
    """SELECT conv_id, role, count(*) AS votes FROM conversations GROUP BY ALL"""
)
def model_votes(t: Tables):
    """Votes per conversation; the role stands in for the model that wrote a turn."""
    rows = t.conversations.select("conv_id", F.col("role").alias("model"))
    return cards.model_votes(rows).withColumnRenamed("model", "role")


@query(
    """SELECT role AS content_type, count(*) AS n_turns FROM conversations
       WHERE role NOT IN ('user', 'assistant') GROUP BY role"""
)
def unknown_types(t: Tables):
    """Coverage audit: turn kinds outside the known set (user and assistant are mapped to known types)."""
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "code").otherwise(F.col("role"))
    return cards.unknown_content_types(t.conversations.select(kind.alias("content_type")))


@query(
    f"""WITH {_SQL_TURNS}, {_SQL_HEADS}
    SELECT count(*) AS n_chats, sum(n)::BIGINT AS n_turns, sum(u)::BIGINT AS n_user_turns, sum(a)::BIGINT AS n_assistant_turns,
      min(create_date) AS date_min, max(create_date) AS date_max
    FROM heads JOIN (SELECT conv_id, count(*) n, count(*) FILTER (role = 'user') u, count(*) FILTER (role = 'assistant') a
                     FROM turns GROUP BY 1) USING (conv_id)"""
)
def catalog_info(t: Tables):
    return catalog.info(cards.signals(turns(t)).join(heads(t), "conv_id"))


_SQL_GROUPS = f"""
grp AS (
  SELECT CASE WHEN k = '' THEN 'unclustered-' || left(conv_id::VARCHAR, 8) ELSE list_min(string_split(k, '-')) END AS slug,
    list_max(string_split(k, '-')) AS cid, h.*
  FROM (SELECT *, {_KEBAB.format('title')} AS k FROM heads) h
)"""


def grouped(t: Tables):
    """Conversations in made-up clusters: by the alphabetically first word of the whole title."""
    slug = T.kebab(F.col("title"))
    own = F.concat(F.lit("unclustered-"), F.substring(F.col("conv_id").cast("string"), 1, 8))
    return heads(t).withColumn("cluster_id", F.when(slug == "", own).otherwise(F.array_min(F.split(slug, "-"))))


@query(
    f"""WITH {_SQL_HEADS}, {_SQL_GROUPS}
    SELECT slug, count(*) AS n_conversations FROM grp GROUP BY slug HAVING count(*) >= 2"""
)
def project_filter(t: Tables):
    groups = grouped(t).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_conversations"))
    keep = catalog.is_project(F.lit(0), F.col("n_conversations"))
    return groups.where(keep).select(F.col("cluster_id").alias("slug"), "n_conversations")


@query(
    f"""WITH {_SQL_TURNS}, {_SQL_HEADS}, {_SQL_GROUPS},
    sig AS (SELECT conv_id, count(*) n, count(*) FILTER (role = 'user') u, count(*) FILTER (role = 'assistant') a,
              bool_or(contains(text, '```')) AS code FROM turns GROUP BY 1)
    SELECT slug, count(*) AS n_conversations, min(create_date) AS start_date, max(create_date) AS end_date,
      sum(n)::BIGINT AS n_turns, sum(u)::BIGINT AS n_user_turns, sum(a)::BIGINT AS n_assistant_turns,
      bool_or(code)::BIGINT AS has_code, 0::BIGINT AS n_versions
    FROM grp JOIN sig USING (conv_id) GROUP BY slug"""
)
def cluster_rollup(t: Tables):
    """Cluster facts in list order (most conversations first, then slug)."""
    rows = turns(t)
    members = grouped(t).join(cards.signals(rows), "conv_id")
    arch = cards.archives(rows)
    files = cards.files(rows)
    slugs = members.select("cluster_id", F.col("cluster_id").alias("slug")).distinct()
    out = clusters.roll_up(members, slugs, clusters.cluster_archives(members, arch), clusters.cluster_files(members, files))
    return out.select(
        "slug", "n_conversations", "start_date", "end_date", "n_turns", "n_user_turns", "n_assistant_turns",
        F.col("has_code").cast("bigint").alias("has_code"), "n_versions",
    ).orderBy(F.desc("n_conversations"), "slug")


@query(
    f"""WITH {_SQL_HEADS}, {_SQL_GROUPS},
    votes AS (
      SELECT cid, slug, count(*) AS n, min(create_time) AS t0, arg_min(conv_id, (create_time, conv_id)) AS c0
      FROM grp GROUP BY 1, 2)
    SELECT cid AS cluster_id, arg_min(slug, (-n, t0, c0)) AS slug FROM votes GROUP BY cid"""
)
def canonical_slug(t: Tables):
    """Most common slug among the members of a cluster (here: titles with one alphabetically last word)."""
    rows = grouped(t)
    primary = rows.select("conv_id", F.col("cluster_id").alias("slug"))
    members = rows.withColumn("cluster_id", F.array_max(F.split(T.kebab(F.col("title")), "-")))
    return clusters.canonical_slug(members, primary)


@query(
    """WITH RECURSIVE
    n AS (SELECT conv_id, turn, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN turn - 2 ELSE turn - 1 END AS parent
          FROM conversations),
    ends AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1),
    walk AS (
      SELECT conv_id, turn, 0::BIGINT AS up FROM ends
      UNION ALL
      SELECT w.conv_id, n.parent, w.up + 1 FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.turn
      WHERE EXISTS (SELECT 1 FROM n p WHERE p.conv_id = w.conv_id AND p.turn = n.parent))
    SELECT conv_id, turn, up FROM walk"""
)
def turn_chain_path(t: Tables):
    """Active branch of each conversation. A turn that repeats the previous role is a second try
    and hangs off the turn before that, so its sibling is an abandoned branch."""
    c = t.conversations
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("prev_role"))
    parent = F.when(F.col("role") == F.col("prev_role"), F.col("turn") - 2).otherwise(F.col("turn") - 1)
    nodes = c.join(before, ["conv_id", "turn"], "left").select("conv_id", F.col("turn").alias("node_id"), parent.alias("parent"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("node_id"))
    return C.active_path(nodes, ends).withColumnRenamed("node_id", "turn")


@query(
    f"""WITH {_SQL_HEADS}
    SELECT conv_id, array_to_string(list_filter(string_split({_KEBAB.format('title')}, '-'), lambda w: w <> '')[1:12], ' ') AS keywords,
      {_KEBAB.format('title')} AS slug FROM heads"""
)
def title_slugs(t: Tables):
    return heads(t).select(
        "conv_id", F.array_join(T.title_keywords(F.col("title")), " ").alias("keywords"), T.kebab(F.col("title")).alias("slug")
    )


#: Marks of containers and strings, some of them escaped in JSON.
_MARKS = ' "]]}\\ [{"\\" ['


@query(
    f"""WITH m AS (SELECT conv_id, turn, (conv_id * 7 + turn * 31) % 200 AS deep, regexp_replace('{_MARKS}' || text, '^\\s+|\\s+$', '', 'g') AS t
          FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, '[execution output] ' || t || CASE WHEN deep % 3 = 0 THEN chr(10) || chr(10) || t ELSE '' END AS text FROM m"""
)
def message_texts(t: Tables):
    """Texts read out of message trees whose content lies 1 to 200 containers deep, full of quotes and brackets.

    Every third message holds its text twice in its innermost list, with an empty one between them.
    """
    deep = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 31, F.lit(200)).cast("int")
    opened = F.transform(F.sequence(F.lit(0), deep), lambda i: F.when((F.col("turn") + i) % 2 == 0, F.lit("[")).otherwise(F.lit('{"note": "q \\"]]]]]] e", "text":')))
    closed = F.reverse(F.transform(opened, lambda o: F.when(o == "[", F.lit("]")).otherwise(F.lit("}"))))
    text = F.regexp_replace(F.to_json(F.struct(F.concat(F.lit(_MARKS), F.col("text")).alias("t"))), r'^\{"t":|\}$', "")
    inner = F.when(deep % 3 == 0, F.concat(F.lit("["), text, F.lit(',"", {"none": [1]}, '), text, F.lit("]"))).otherwise(text)
    nested = F.concat(F.array_join(opened, ""), inner, F.array_join(closed, ""))
    message = F.concat(F.lit('{"author":{"role":"tool"},"content":{"content_type":"execution_output","text":'), nested, F.lit("}}"))
    rows = t.conversations.where(F.col("text").isNotNull()).select("conv_id", "turn", message.alias("message"))
    return C.read_messages(rows).select("conv_id", "turn", "text")
