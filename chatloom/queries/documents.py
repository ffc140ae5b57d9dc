"""Queries over ``documents``: search, chunks, redaction, budgets, classification."""

from pyspark.sql import functions as F, types as ty

from chatloom import banks
from chatloom.functions import text as T
from chatloom.operators import bundles, catalog, chunks, classify, contracts, items, perf, quality, redaction, retrieval, telemetry
from chatloom.functions import redact
from chatloom.queries.base import Tables, query, values

NOW = "2024-12-31"
_DAY = "strftime(DATE '2024-01-01' + (n_chars % 365)::INTEGER, '%Y-%m-%d')"


def dated(t: Tables):
    """Documents with a title and a date (the length stands in for the age)."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("n_chars", F.lit(365)).cast("int"))
    return t.documents.select(
        "doc_id", "text", "lang", "source", "n_chars", F.col("source").alias("title"),
        F.date_format(day, "yyyy-MM-dd").alias("update_date"),
    )


# --- search ---------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def search_contains(t: Tables):
    return t.documents.where(T.text_matches(F.col("text"), "TION", ignore_case=True)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(the|The)([^\\p{L}\\p{N}_]|$)')")
def search_word(t: Tables):
    return t.documents.where(T.text_matches(F.col("text"), "[tT]he", word=True)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?s)^.*the .*\\..*and.*$')")
def search_glob(t: Tables):
    return t.documents.where(T.text_matches(F.col("text"), "the *.*and")).select("doc_id")


@query(
    f"""SELECT doc_id, source AS title, {_DAY} AS update_date,
      CASE WHEN contains(text, 'and ') THEN 'text' ELSE 'title' END AS matched_in,
      CASE WHEN contains(text, 'and ') THEN regexp_replace(list_filter(string_split(text, E'\\n'), lambda l: contains(l, 'and '))[1], '^\\s+|\\s+$', '', 'g')
           ELSE source END AS snippet
    FROM documents WHERE contains(text, 'and ') OR contains(source, 'and ')"""
)
def search_snippet(t: Tables):
    docs = dated(t).withColumn("files", F.array().cast("array<string>"))
    return catalog.search_texts(docs, "and ", key="doc_id", scope_all=True)


@query(
    """WITH l AS (SELECT doc_id, string_split(text, E'\\n') AS ls FROM documents),
    n AS (SELECT doc_id, ls, len(ls) AS total, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
    m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, count(*) OVER (PARTITION BY doc_id) AS total_found
          FROM n WHERE regexp_matches(line, '@'))
    SELECT doc_id, p::BIGINT AS p, i::BIGINT AS matched_line, greatest(1, i - 3)::BIGINT AS start,
      least(total, i + 2)::BIGINT AS "end", total_found::BIGINT AS total_found,
      md5(array_to_string(ls[greatest(1, i - 3):least(total, i + 2)], E'\\n')) AS block_md5
    FROM m"""
)
def context_windows(t: Tables):
    rows = catalog.context_windows(t.documents, "doc_id", "text", "@", before=3, after=2)
    ints = [F.col(c).cast("bigint").alias(c) for c in ("p", "matched_line", "start", "end", "total_found")]
    return rows.select("doc_id", *ints, F.md5("block").alias("block_md5"))


@query(
    f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM benchmark),
    w AS (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY length(word) DESC, word) AS word_no FROM q WHERE length(word) > 3),
    d AS (SELECT doc_id, lower(text) AS hay, {_DAY} AS update_date FROM documents),
    hit AS (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY update_date DESC, doc_id) AS pos
            FROM (SELECT DISTINCT word FROM w) JOIN d ON contains(hay, word) QUALIFY pos <= 5),
    f AS (SELECT query_id, doc_id, min((word_no, pos)) AS k, arg_min(word, (word_no, pos)) AS word FROM w JOIN hit USING (word) GROUP BY 1, 2)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS n, doc_id, word FROM f QUALIFY n <= 5"""
)
def keyword_fallback(t: Tables):
    """Keyword search of all benchmark questions over all documents."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = retrieval.keyword_fallback(asked, dated(t), k=5)
    return out.select("query_id", F.col("n").cast("bigint").alias("n"), "doc_id", "word")


@query(
    """WITH l AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents),
    n AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l)
    SELECT doc_id, line_no::BIGINT AS line_no, left(trim(line, ' '), 200) AS line FROM n
    WHERE list_bool_or(list_transform("""
    + "["
    + ", ".join("'" + w + "'" for w in banks.LOG_ERROR_WORDS)
    + """], lambda w: contains(lower(line), w)))
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= 8"""
)
def log_errors(t: Tables):
    """The last error lines of every text."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return telemetry.log_errors(lines, "doc_id", "line_no", "line").withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n_spans,
      coalesce(length(array_to_string(regexp_extract_all(text, '[0-9]+'), '')), 0)::BIGINT AS matched_chars
    FROM documents"""
)
def match_spans(t: Tables):
    spans = T.match_spans(F.col("text"), "[0-9]+")
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    right = F.forall("s", lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) == x["matched"])
    rows = t.documents.select("doc_id", "text", spans.alias("s"))
    # A span that does not cut out its own match would change the count.
    return rows.select(
        "doc_id", F.when(right, F.size("s")).otherwise(-1).cast("bigint").alias("n_spans"), total.cast("bigint").alias("matched_chars")
    )


@query(
    """SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')),
        lambda w: length(w) > 3), lambda w: {'n': -length(w), 'w': w})), lambda x: x.w), ' ') AS words
    FROM documents"""
)
def salient_words(t: Tables):
    """All distinct words of more than three letters, longest first."""
    return t.documents.select("doc_id", F.array_join(T.salient_words(F.col("text")), " ").alias("words"))


# --- chunks ---------------------------------------------------------------

_SQL_CHUNKS = """
c AS (
  SELECT doc_id, text, n, unnest(range(0, CASE WHEN n <= 1200 THEN 1 ELSE ((n - 1200 + 999) // 1000) * 1000 + 1 END, 1000)) AS s
  FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_matches(text, '\\S'))),
chunks AS (
  SELECT doc_id, s AS start, least(s + 1200, n) AS "end", substring(text, (s + 1)::INTEGER, 1200) AS chunk FROM c
  WHERE regexp_matches(substring(text, (s + 1)::INTEGER, 1200), '\\S'))"""


@query(f'WITH {_SQL_CHUNKS} SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", md5(chunk) AS chunk_md5 FROM chunks')
def chunk_windows(t: Tables):
    rows = chunks.windows(t.documents.select("doc_id", "text"))
    return rows.select("doc_id", "start", "end", F.md5("text").alias("chunk_md5"))


@query(
    f"""WITH {_SQL_CHUNKS}, k AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1)
    SELECT doc_id, n_chunks, (sum(n_chunks) OVER (ORDER BY doc_id) - n_chunks)::BIGINT AS row_start,
      (sum(n_chunks) OVER (ORDER BY doc_id))::BIGINT AS row_end FROM k"""
)
def chunk_offsets(t: Tables):
    n = chunks.windows(t.documents.select("doc_id", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return chunks.row_offsets(n, "doc_id")


@query(
    f"""WITH {_SQL_CHUNKS}, k AS (SELECT 'doc-' || doc_id AS key, count(*) AS n_chunks FROM chunks GROUP BY 1)
    SELECT key, n_chunks, (sum(n_chunks) OVER (ORDER BY key) - n_chunks)::BIGINT AS row_start,
      (sum(n_chunks) OVER (ORDER BY key))::BIGINT AS row_end FROM k"""
)
def chunk_offsets_text(t: Tables):
    """Row offsets of chats whose ids are texts."""
    rows = chunks.windows(t.documents.select(F.concat(F.lit("doc-"), "doc_id").alias("key"), "text"))
    return chunks.row_offsets(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_chunks")), "key")


@query(
    f"""WITH {_SQL_CHUNKS}
    SELECT doc_id, start::BIGINT AS start, md5(source || ' (' || {_DAY} || E')\\n' || chunk) AS input_md5
    FROM chunks JOIN documents USING (doc_id)"""
)
def embed_input(t: Tables):
    rows = chunks.windows(dated(t).select("doc_id", "title", "update_date", "text"))
    full = chunks.embed_input(F.col("title"), F.col("update_date"), F.col("text"))
    return rows.select("doc_id", "start", F.md5(full).alias("input_md5"))


@query(f"SELECT doc_id, sha1(source || chr(0) || {_DAY} || chr(0) || text) AS hash FROM documents")
def content_hash(t: Tables):
    return dated(t).select("doc_id", chunks.content_hash(F.col("title"), F.col("update_date"), F.col("text")).alias("hash"))


@query(
    f"""WITH {_SQL_CHUNKS}, k AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1)
    SELECT k.doc_id, sha1(text) AS hash, n_chunks, (quality = 1)::BIGINT AS reused
    FROM k JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)
    """.replace("(quality = 1)::BIGINT", "coalesce(quality = 1, false)::BIGINT")
)
def reuse_plan(t: Tables):
    """Documents labelled good were indexed as they are now; the other labelled ones changed since."""
    n = chunks.windows(t.documents.select("doc_id", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    now = t.documents.select("doc_id", F.sha1("text").alias("hash")).join(n, "doc_id")
    before = now.join(t.labels, "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("hash")).otherwise(F.lit("old")).alias("hash"), "n_chunks"
    )
    return chunks.reuse_plan(now, before, "doc_id").withColumn("reused", F.col("reused").cast("bigint"))


@query(
    """SELECT count(*) AS n_catalog, (SELECT count(DISTINCT doc_id) FROM labels) AS n_indexed,
      count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS n_missing,
      greatest(0, count(*) - (SELECT count(DISTINCT doc_id) FROM labels)) AS delta,
      (count(*) - (SELECT count(DISTINCT doc_id) FROM labels) BETWEEN 1 AND 200)::BIGINT AS auto_refresh
    FROM documents"""
)
def index_delta(t: Tables):
    return chunks.index_delta(t.documents, t.labels, "doc_id")


@query(
    """SELECT doc_id, md5(text) AS bundle_sha FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)"""
)
def resume_work(t: Tables):
    """Bundles still to do; labelled, clean documents were done on the same content."""
    todo = t.documents.select("doc_id", F.md5("text").alias("bundle_sha"))
    sha = F.when(F.col("toxic") == 0, F.col("bundle_sha")).otherwise(F.lit("stale"))
    done = todo.join(t.labels, "doc_id").select("doc_id", sha.alias("bundle_sha"))
    return chunks.resume(todo, done, "doc_id").select("doc_id", "bundle_sha")


# --- redaction ------------------------------------------------------------


def _q(s: str) -> str:
    return s.replace("'", "''")


def _sql_scrubbed() -> str:
    text = "text"
    for _, placeholder, regex in banks.REDACTION_PATTERNS:
        text = f"regexp_replace({text}, '{_q(regex)}', '{placeholder}', 'g')"
    return text


def _sql_stages() -> str:
    text, counts = "text", []
    for _, placeholder, regex in banks.REDACTION_PATTERNS:
        counts.append(f"len(regexp_extract_all({text}, '{_q(regex)}'))")
        text = f"regexp_replace({text}, '{_q(regex)}', '{placeholder}', 'g')"
    return " + ".join(counts)


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, md5(m) AS match_md5 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_q(rx)}')) AS m FROM documents)"
        for kind, _, rx in banks.REDACTION_PATTERNS
    )
)
def redact_find(t: Tables):
    return redaction.findings(t.documents, "doc_id", "text").select("doc_id", "kind", F.md5("match").alias("match_md5"))


@query(f"SELECT doc_id, md5({_sql_scrubbed()}) AS scrubbed_md5, ({_sql_stages()})::BIGINT AS n_findings FROM documents")
def redact_scrub(t: Tables):
    rows = redact.scrub_counts(t.documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", F.md5("text").alias("scrubbed_md5"), "n_findings")


@query(f"SELECT doc_id, 'owner@keys.org' AS names, md5({_sql_scrubbed()}) AS said_md5, lang, n_chars, TRUE AS idempotent FROM documents")
def scrub_trees(t: Tables):
    """Texts inside record trees of no fixed schema: values are scrubbed at any depth, names stay, a second time changes nothing."""
    said = F.struct(F.col("text").alias("said"), F.col("lang"), F.col("n_chars"), F.array(F.array(F.struct(F.col("text").alias("again")))).alias("deep"))
    tree = F.parse_json(F.to_json(F.struct("doc_id", F.create_map(F.lit("owner@keys.org"), F.array(said)).alias("by"))))
    clean = lambda c: redact.scrub_value(F.col(c), ty.VariantType())
    rows = t.documents.select("doc_id", tree.alias("tree")).select("doc_id", clean("tree").alias("once"))
    rows = rows.select("doc_id", "once", (F.to_json(clean("once")) == F.to_json("once")).alias("idempotent"))
    at = lambda path, kind: F.variant_get(F.col("once"), f"$.by['owner@keys.org'][0].{path}", kind)
    both = at("said", "string").eqNullSafe(at("deep[0][0].again", "string"))
    return rows.select(
        "doc_id", F.array_join(F.map_keys(F.variant_get(F.col("once"), "$.by", "map<string,variant>")), ",").alias("names"),
        F.md5(at("said", "string")).alias("said_md5"), at("lang", "string").alias("lang"), at("n_chars", "bigint").alias("n_chars"), (F.col("idempotent") & both).alias("idempotent"))


_TERMS, _RAW = ["the", "Ing THAT"], ["[0-9]{3,}", "(broken"]


def _sql_custom() -> str:
    text = "text"
    for term in _TERMS:  # twice, as neighbours share the character between them
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{banks.CUSTOM_PLACEHOLDER}\\2', 'gi')"
    return f"regexp_replace({text}, '{_RAW[0]}', '{banks.CUSTOM_PLACEHOLDER}', 'g')"


@query(f"WITH d AS (SELECT doc_id, {_sql_custom()} AS text FROM documents) SELECT doc_id, md5({_sql_scrubbed()}) AS scrubbed_md5 FROM d")
def scrub_dictionary(t: Tables):
    """A user's own terms (whole words in any case) and patterns go first; a pattern that cannot be read is left out."""
    custom = redact.dictionary(_TERMS, _RAW)
    return t.documents.select("doc_id", F.md5(redact.scrub(F.col("text"), custom)).alias("scrubbed_md5"))


@query(
    "SELECT page_id, field, kind, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT page_id, '{f}' AS field, '{kind}' AS kind, unnest(regexp_extract_all({f}, '{_q(rx)}')) AS m FROM pages"
        for f in ("url", "html")
        for kind, _, rx in banks.REDACTION_PATTERNS
    )
    + ") GROUP BY ALL"
)
def publish_review(t: Tables):
    """Findings per named field, over pages."""
    found = redaction.review(t.pages, "page_id", ["url", "html"])
    return found.groupBy("page_id", "field", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- budgets and cost -----------------------------------------------------

_BUDGET = 120_000
_SQL_SHARES = f"""
b AS (SELECT doc_id, source, text, length(text) + 10 AS need FROM documents),
s AS (
  SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY source) AS n,
    coalesce(sum(need) OVER (PARTITION BY source ORDER BY need, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b WINDOW w AS (PARTITION BY source ORDER BY need, doc_id)),
x AS (SELECT *, (({_BUDGET} - before) // (n - r)) AS share FROM s),
lvl AS (SELECT source, min(r) AS r0, arg_min(share, r) AS level FROM x WHERE need > share OR share <= 0 GROUP BY source),
alloc AS (
  SELECT x.*, CASE WHEN r0 IS NULL OR r < r0 THEN need ELSE greatest(level, 0) END AS alloc
  FROM x LEFT JOIN lvl USING (source))"""


def _shares(t: Tables):
    need = t.documents.withColumn("need", F.length("text") + 10)
    return bundles.fair_shares(need, ["source"], "need", F.lit(_BUDGET))


@query(f"WITH {_SQL_SHARES} SELECT doc_id, source, need::BIGINT AS need, alloc::BIGINT AS alloc FROM alloc")
def fair_share_budget(t: Tables):
    return _shares(t).select("doc_id", "source", F.col("need").cast("bigint").alias("need"), "alloc")


@query(
    f"""WITH {_SQL_SHARES}
    SELECT doc_id, md5(CASE WHEN need <= alloc THEN '--- head--' || text
      ELSE '--- head--' || left(text, greatest(alloc - 10, 0)::INTEGER) || E'\\n[...conversation truncated to fit bundle budget...]' END) AS block_md5
    FROM alloc"""
)
def bundle_truncate(t: Tables):
    block = bundles.fit_text(F.lit("--- head--"), F.col("text"), F.col("alloc"))
    return _shares(t).select("doc_id", F.md5(block).alias("block_md5"))


_RATES = values([r for r in banks.RATES])


@query(
    f"""WITH r AS (SELECT * FROM {_RATES} v(provider, model, i, o)),
    d AS (SELECT source, CASE lang WHEN 'en' THEN 'openai' WHEN 'fr' THEN 'anthropic' WHEN 'de' THEN 'codex' ELSE 'nobody' END AS provider,
            CASE lang WHEN 'en' THEN 'gpt-5-mini' ELSE 'unlisted' END AS model, n_chars FROM documents),
    n AS (SELECT source, provider, model, count(*) AS n_items, sum(greatest(n_chars, 0) // 4)::BIGINT AS est_input_tokens,
            count(*) * 1500 AS est_output_tokens FROM d GROUP BY ALL),
    p AS (SELECT n.*, coalesce(e.i, s.i, 0) AS i, coalesce(e.o, s.o, 0) AS o,
            CASE WHEN n.provider = 'codex' THEN 1.25 ELSE coalesce(e.i, s.i, 0) END AS si,
            CASE WHEN n.provider = 'codex' THEN 10.0 ELSE coalesce(e.o, s.o, 0) END AS so
          FROM n LEFT JOIN r e ON e.provider = n.provider AND e.model = n.model AND e.model <> '*'
          LEFT JOIN r s ON s.provider = n.provider AND s.model = '*')
    SELECT source, provider, model, n_items, est_input_tokens, est_output_tokens,
      round(est_input_tokens / 1e6 * i::DOUBLE + est_output_tokens / 1e6 * o::DOUBLE, 4) AS est_usd,
      round((est_input_tokens / 1e6 * i::DOUBLE + est_output_tokens / 1e6 * o::DOUBLE) / n_items, 5) AS est_usd_per_item,
      round(est_input_tokens / 1e6 * si::DOUBLE + est_output_tokens / 1e6 * so::DOUBLE, 4) AS shadow_usd FROM p"""
)
def cost_estimate(t: Tables):
    """Projected cost per source; models without a rate fall back to the provider's wildcard, then to zero."""
    by_lang = F.when(F.col("lang") == "en", "openai").when(F.col("lang") == "fr", "anthropic").when(F.col("lang") == "de", "codex").otherwise("nobody")
    model = F.when(F.col("lang") == "en", "gpt-5-mini").otherwise("unlisted")
    rows = t.documents.select("source", by_lang.alias("provider"), model.alias("model"), "n_chars")
    return perf.estimate(rows, "n_chars", ["source"])


@query(
    """WITH b AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) > 2) AS q FROM benchmark),
    d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
    s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.\\n]+')) AS sentence FROM documents),
    bs AS (SELECT item_id, unnest(regexp_extract_all(text, '[^.\\n]+')) AS sentence FROM benchmark),
    pair AS (SELECT DISTINCT item_id, doc_id FROM bs JOIN s ON regexp_replace(bs.sentence, '^\\s+|\\s+$', '', 'g') = regexp_replace(s.sentence, '^\\s+|\\s+$', '', 'g')
             WHERE regexp_replace(bs.sentence, '^\\s+|\\s+$', '', 'g') <> '')
    SELECT item_id, doc_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, w)) / len(q) END, 6) AS overlap
    FROM pair JOIN b USING (item_id) JOIN d USING (doc_id)"""
)
def lexical_overlap(t: Tables):
    """Word overlap of each question with the documents that share a sentence with it."""
    def sentences(df, key):
        return df.select(
            key, F.explode(F.transform(F.regexp_extract_all("text", F.lit("[^.\n]+"), F.lit(0)), T.strip)).alias("sentence")
        ).where(F.col("sentence") != "").distinct()

    b, d = t.benchmark, t.documents
    pairs = sentences(b, "item_id").join(sentences(d, "doc_id"), "sentence").select("item_id", "doc_id").distinct()
    both = pairs.join(b.withColumnRenamed("text", "question"), "item_id").join(d.select("doc_id", "text"), "doc_id")
    return both.select("item_id", "doc_id", F.round(T.lexical_overlap(F.col("question"), F.col("text")), 6).alias("overlap"))


# --- classification -------------------------------------------------------

_ARCH = values([(w, a, 11 + i) for i, (a, ws) in enumerate(banks.ARCHETYPE_KEYWORDS.items()) for w in ws])
_DOM = values([(w, d, s, i) for i, (d, s, ws) in enumerate(banks.DOMAIN_KEYWORDS) for w in ws])
_SQL_SCORES = f"""
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
c AS (SELECT doc_id, CASE lang WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END AS nv, contains(text, '@') AS code,
        contains(text, '!') AS image, (n_chars // 2000) AS n_data, (n_chars // 5000) AS n_code, (n_chars // 1000) AS n_files,
        len(string_split(text, E'\\n')) AS n_conv FROM documents),
pts AS (
  SELECT doc_id, 'software_app' AS a, 3.0 AS p, 0 AS seq FROM c WHERE nv >= 2
  UNION ALL SELECT doc_id, 'software_app', 1.0, 1 FROM c WHERE nv = 1
  UNION ALL SELECT doc_id, 'automation_or_diagnostic_script', 0.5, 2 FROM c WHERE nv = 1
  UNION ALL SELECT doc_id, 'media_generation', 3.0, 6 FROM c WHERE image AND NOT code AND nv = 0
  UNION ALL SELECT doc_id, 'automation_or_diagnostic_script', 1.0, 7 FROM c WHERE n_code BETWEEN 1 AND 3 AND nv = 0
  UNION ALL SELECT doc_id, 'data_extraction_processing', 1.0, 8 FROM c WHERE n_data >= 2
  UNION ALL SELECT doc_id, 'knowledge_qa', 1.0, 9 FROM c WHERE n_files = 0 AND nv = 0 AND NOT image
  UNION ALL SELECT doc_id, 'advisory_troubleshooting', 0.5, 10 FROM c WHERE n_files = 0 AND nv = 0 AND NOT image AND n_conv = 1
  UNION ALL SELECT doc_id, a, 0.8, seq FROM w JOIN {_ARCH} k(word, a, seq) USING (word)),
scored AS (SELECT doc_id, a, round(sum(p), 2)::DOUBLE AS score, min(seq) AS seq FROM pts GROUP BY 1, 2),
filled AS (SELECT * FROM scored UNION ALL SELECT doc_id, 'knowledge_qa', 0.5, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM scored)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) AS rank FROM filled QUALIFY rank <= 3),
hits AS (SELECT doc_id, d, s, seq, count(*) AS h FROM w JOIN {_DOM} k(word, d, s, seq) USING (word) GROUP BY ALL),
dom AS (SELECT c.doc_id, coalesce(x.d, CASE WHEN code OR nv >= 1 THEN 'software_engineering' ELSE 'general_knowledge' END) AS domain, x.s AS subdomain
        FROM c LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, seq) = 1) x USING (doc_id))"""


def _facts(t: Tables):
    lang, text = F.col("lang"), F.col("text")
    false = F.lit(False)
    flags = ("f_setup", "f_pyproject", "f_package", "f_skill", "f_json", "f_schema", "f_glossary")
    return t.documents.select(
        "doc_id",
        classify.bank_words(T.words(text)).alias("words"),
        F.when(lang == "de", 2).when(lang == "fr", 1).otherwise(0).alias("n_versions"),
        F.contains(text, F.lit("@")).alias("has_code"),
        F.contains(text, F.lit("!")).alias("has_image"),
        F.floor(F.col("n_chars") / 2000).alias("n_data"),
        F.floor(F.col("n_chars") / 5000).alias("n_code"),
        F.floor(F.col("n_chars") / 1000).alias("n_files"),
        F.size(F.split("text", "\n")).alias("n_conv"),
        *[false.alias(f) for f in flags],
    )


def _classified(t: Tables):
    """Facts and classes of every document, in one scan of the texts and without a shuffle."""
    facts = _facts(t)
    coded = F.col("has_code") | (F.col("n_versions") >= 1)
    return classify.classified(facts, "words", {c: F.col(c) for c in facts.columns}, coded)


@query(f"WITH {_SQL_SCORES} SELECT doc_id, a AS archetype, score, rank FROM ranked")
def rule_classify(t: Tables):
    """Primary and secondary archetypes of every document by rule points."""
    return classify.ranked(_classified(t), "doc_id").select("doc_id", "archetype", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_SQL_SCORES} SELECT doc_id, domain, subdomain FROM dom")
def domain_pairs(t: Tables):
    return _classified(t).select("doc_id", "domain", "subdomain")


@query(f"WITH {_SQL_SCORES} SELECT a AS archetype, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY a")
def class_distribution(t: Tables):
    first = _classified(t).select(F.element_at("top", 1)["archetype"].alias("archetype"))
    return first.groupBy("archetype").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "archetype")


_COG = values(list(banks.ARCHETYPE_COGNITIVE.items()))
_VER = values(list(banks.COGNITIVE_VERIFIABILITY.items()))
_SPECIAL = ", ".join(f"'{d}'" for d in banks.SPECIALIZED_DOMAINS)
_TIERS = values(banks.DIFFICULTY_TIERS)


@query(
    f"""WITH {_SQL_SCORES},
    x AS (SELECT c.*, r.a AS archetype, domain, coalesce(cog, 'retrieve') AS cog FROM c JOIN ranked r ON r.doc_id = c.doc_id AND r.rank = 1
          JOIN dom ON dom.doc_id = c.doc_id LEFT JOIN {_COG} k(archetype, cog) ON k.archetype = r.a),
    y AS (SELECT *, least(3, CASE WHEN code OR nv >= 2 THEN 2 WHEN nv = 1 THEN 1 ELSE 0 END + (cog = 'reason_analyze')::INT) AS steps,
          CASE WHEN domain IN ({_SPECIAL}) THEN 2 WHEN domain IN ('general_knowledge', 'personal_productivity') THEN 0 ELSE 1 END AS special,
          CASE WHEN cog IN ('converse_advise', 'generate_create', 'plan_strategize', 'explain') THEN 2 ELSE 1 END AS ambiguity,
          least(3, CASE WHEN n_conv >= 4 THEN 2 WHEN n_conv >= 2 THEN 1 ELSE 0 END + (nv >= 2)::INT) AS load FROM x)
    SELECT doc_id, cog AS cognitive_type, (steps + special + ambiguity + load)::BIGINT AS difficulty_score, tier,
      CASE WHEN domain = 'arts_creative' OR archetype = 'media_generation' THEN 'subjective' ELSE coalesce(ver, 'rubric') END AS verifiability_class,
      CASE WHEN image AND NOT code THEN CASE WHEN n_data >= 1 THEN 'mixed' ELSE 'image' END
           WHEN code THEN CASE WHEN image OR n_data >= 2 THEN 'mixed' ELSE 'code' END WHEN n_data >= 2 THEN 'data' ELSE 'text' END AS modality
    FROM y JOIN {_TIERS} tt(tier, weight, lo, hi) ON steps + special + ambiguity + load BETWEEN lo AND hi
    LEFT JOIN {_VER} v(cog, ver) USING (cog)"""
)
def difficulty_tier(t: Tables):
    """Evaluation facets of every document's primary class."""
    wide = _classified(t).withColumn("archetype", F.element_at("top", 1)["archetype"])
    f = classify.facets(F.col("archetype"), F.col("domain"), {c: F.col(c) for c in wide.columns})
    return wide.select(
        "doc_id", f["cognitive_type"].alias("cognitive_type"), f["difficulty_score"].cast("bigint").alias("difficulty_score"),
        f["tier"].alias("tier"), f["verifiability_class"].alias("verifiability_class"), f["modality"].alias("modality"),
    )


# --- other ----------------------------------------------------------------


@query("SELECT source, count(*) AS chats FROM documents WHERE source <> '' GROUP BY source")
def chats_by_archive(t: Tables):
    return t.documents.where("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("chats"))


@query(
    f"""SELECT doc_id, source AS title, {_DAY} AS update_date, md5(text) AS text_md5
    FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '\\S')"""
)
def index_input(t: Tables):
    """Dated, titled, non-blank records of the labelled documents."""
    heads = dated(t).join(t.labels.select("doc_id"), "doc_id").select(
        "doc_id", "title", F.lit(None).cast("string").alias("update_date"), F.col("update_date").alias("create_date")
    )
    out = chunks.records(heads, t.documents.select("doc_id", "text"), "doc_id")
    return out.select("doc_id", "title", "update_date", F.md5("text").alias("text_md5"))


@query(
    f"""WITH {_SQL_CHUNKS},
    w AS (SELECT doc_id, start, unnest(regexp_extract_all(lower(d.source || ' (' || d.day || ')' || E'\\n' || chunk), '[a-z0-9]+')) AS word
          FROM chunks JOIN (SELECT doc_id, source, {_DAY} AS day FROM documents) d USING (doc_id))
    SELECT doc_id, start::BIGINT AS start, ('0x' || substr(md5(word), 1, 7))::BIGINT % 64 AS i, count(*) AS n FROM w GROUP BY ALL"""
)
def embed_vectors(t: Tables):
    """Sparse chunk vectors of all documents by the hashed bag of words."""
    rows = chunks.windows(dated(t).select("doc_id", "title", "update_date", "text")).withColumn(
        "inp", chunks.embed_input(F.col("title"), F.col("update_date"), F.col("text"))
    )
    return chunks.hashed_counts(rows, "inp", ["doc_id", "start"])


@query(
    """WITH l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, text FROM documents)
    SELECT doc_id, n::BIGINT AS words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS distinct_words FROM l"""
)
def word_tokens(t: Tables):
    w = T.words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("bigint").alias("words"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct_words"))


@query(
    """SELECT doc_id, md5(CASE WHEN length(s) > 1200 THEN left(s, 1200) || ' …[truncated]' ELSE s END) AS reduced_md5
    FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') AS s FROM documents)"""
)
def reduce_prose(t: Tables):
    return t.documents.select("doc_id", F.md5(T.reduce_prose(F.col("text"))).alias("reduced_md5"))


@query(
    """WITH l AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'))) AS name FROM documents)
    SELECT doc_id, name, count(*) AS n FROM l GROUP BY ALL"""
)
def token_names(t: Tables):
    """Name tokens per text, folded by case (addresses stand in for archive names)."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0))
    return (
        t.documents.select("doc_id", F.explode(found).alias("raw"))
        .groupBy("doc_id", F.lower("raw").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- cleaned answers ------------------------------------------------------


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN '' ELSE 't' || doc_id || ':forming|u:' END AS objectives, 'r1|' || source || '|r2' AS requirements,
      (CASE doc_id % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1 ELSE 0 END)::DOUBLE AS confidence, doc_id % 4 = 0 AS shape_ok FROM documents"""
)
def cleaned_answers(t: Tables):
    """Lists, numbers and shape of model answers in every state of repair (answers are written from ids and sources)."""
    i = F.col("doc_id")
    of = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    listed = F.concat(
        F.lit('[{"text": " t'), i.cast("string"), F.lit(' ", "role": "'), F.lit(banks.OBJECTIVE_ROLES[0].upper()),
        F.lit('"}, "x", {"role": "' + banks.OBJECTIVE_ROLES[0] + '"}, {"text": "  "}, {"text": "u", "role": "weird"}, 7]'))
    answer = F.concat(
        F.lit('Sure: {"objectives": '), F.when(i % 4 == 2, F.lit('"none"')).otherwise(listed),
        F.lit(', "requirements": [" r1 ", "", 5, "'), F.col("source"), F.lit('", null, "r2"], "confidence": '), of(5, "0.25", '"0.5"', "7", "-1", '"x"'),
        F.lit(', "goal": '), F.when(i % 4 == 1, F.lit("5")).otherwise(F.lit('"g"')), F.when(i % 4 == 3, F.lit("")).otherwise(F.lit(', "primary_archetype": {"id": "a"}')),
        F.lit(', "primary_domain_pair": {"domain": "d"}, "archetype_fields": {}} done'))
    rows = t.documents.select("doc_id", items.recover_object(answer).alias("v"))
    at = lambda path: F.try_variant_get("v", f"$.{path}", "variant")
    told = F.transform(items.clean_objectives(at("objectives")), lambda o: F.concat_ws(":", o["text"], F.coalesce(o["role"], F.lit(""))))
    return rows.select(
        "doc_id", F.array_join(told, "|").alias("objectives"), F.array_join(items.clean_requirements(at("requirements")), "|").alias("requirements"),
        items.clamp_confidence(F.try_variant_get("v", "$.confidence", "string")).alias("confidence"), items.raw_shape_ok(F.col("v")).alias("shape_ok"))
