"""Queries over ``embeddings``: exact retrieval and its evaluation.

Queries are the mean vector of each label, plus the mean of all vectors as a
question without an answer. Ten neighbouring vectors are the chunks of one chat.
"""

from pyspark.sql import functions as F

from chatloom.functions import vectors as V
from chatloom.functions.dates import parse_when, recency_weight
from chatloom.operators import evaluation, retrieval
from chatloom.queries.base import Tables, query
from chatloom.session import cut

_NOW = "2025-01-01"
_SQL_Q = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id // 10 AS chat_id,
        strftime(DATE '2024-01-01' + (vec_id % 365)::INTEGER, '%Y-%m-%d') AS day FROM embeddings),
dims AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
q AS (
  SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY label
  UNION ALL SELECT -1, list(m ORDER BY i) FROM (SELECT i, avg(x) AS m FROM dims GROUP BY i)),
s AS (SELECT query_id, vec_id, chat_id, label, day, round(list_cosine_similarity(qv, v), 9) AS sim FROM q CROSS JOIN e)"""


def vectors(t: Tables):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("vec_id", F.lit(365)).cast("int"))
    return t.embeddings.select(
        F.col("vec_id").alias("row_id"), F.floor(F.col("vec_id") / 10).cast("bigint").alias("chat_id"), "label",
        F.col("embedding").alias("vec"), F.date_format(day, "yyyy-MM-dd").alias("update_date"), F.lit(1.0).alias("weight"),
    )


def questions(t: Tables):
    """Mean vectors by label, averaged per dimension before any shuffle of vectors."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    per_label = dims.select(F.col("label").cast("bigint").alias("query_id"), "i", (F.col("s") / F.col("n")).alias("m"))
    overall = dims.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).select(F.lit(-1).cast("bigint").alias("query_id"), "i", "m")
    # One entry per dimension, so each list is as long as a vector.
    means = per_label.unionByName(overall).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("qvec")
    )
    # A query set is stored once and then read by every step that needs it.
    return cut(means)


def _long(df, *cols):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ("rank", "n", "rerank") else F.col(c) for c in cols])


@query(
    f"""WITH {_SQL_Q} SELECT query_id, vec_id AS row_id, round(sim, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim > 0 QUALIFY rank <= 8"""
)
def cosine_topk(t: Tables):
    hits = retrieval.retrieve(vectors(t), questions(t), k=8, per_chat=0)
    return _long(hits.withColumn("score", F.round("score", 6)), "query_id", "row_id", "score", "rank")


_SQL_CAPPED = """
p AS (SELECT * FROM s WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 32),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, chat_id ORDER BY sim DESC, vec_id) <= 3),
h AS (SELECT query_id, vec_id, chat_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM k QUALIFY rank <= 8)"""


@query(f"WITH {_SQL_Q}, {_SQL_CAPPED} SELECT query_id, vec_id AS row_id, chat_id, rank FROM h")
def capped_topk(t: Tables):
    """Top 8 per query, at most three chunks of one chat inside a pool of 32."""
    return _long(retrieval.retrieve(vectors(t), questions(t)), "query_id", "row_id", "chat_id", "rank")


@query(
    f"""WITH {_SQL_Q},
    w AS (SELECT *, round(sim * power(0.5, greatest(0, date_diff('day', day::DATE, DATE '{_NOW}')) / 365.0), 9) AS score
          FROM s WHERE day >= '2024-03-01'),
    p AS (SELECT * FROM w WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 32),
    k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, chat_id ORDER BY score DESC, vec_id) <= 3)
    SELECT query_id, vec_id AS row_id, round(score, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k QUALIFY rank <= 8"""
)
def recency_topk(t: Tables):
    """Similarity times recency, chats since a date only (filtered before scoring)."""
    recent = vectors(t).where(F.col("update_date") >= "2024-03-01")
    now = F.to_timestamp(F.lit(_NOW))
    weighted = recent.withColumn("weight", recency_weight(parse_when(F.col("update_date")), now, 365.0))
    hits = retrieval.retrieve(weighted, questions(t))
    return _long(hits.withColumn("score", F.round("score", 6)), "query_id", "row_id", "score", "rank")


@query(
    f"""WITH {_SQL_Q}, b AS (SELECT query_id, chat_id, max(sim) AS sim, arg_min(vec_id, (-sim, vec_id)) AS row_id FROM s GROUP BY 1, 2)
    SELECT query_id, chat_id, round(sim, 6) AS score, row_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS rank
    FROM b QUALIFY rank <= 10"""
)
def best_chat_rank(t: Tables):
    hits = retrieval.rank_chats(vectors(t), questions(t), 10)
    return _long(hits.withColumn("score", F.round("score", 6)), "query_id", "chat_id", "score", "row_id", "rank")


@query(
    f"""WITH {_SQL_Q}, {_SQL_CAPPED}, f AS (SELECT query_id, chat_id, min(rank) AS r, arg_min(vec_id, rank) AS row_id FROM h GROUP BY 1, 2)
    SELECT query_id, chat_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS n FROM f"""
)
def sources_numbered(t: Tables):
    hits = retrieval.retrieve(vectors(t), questions(t))
    return _long(retrieval.sources(hits), "query_id", "chat_id", "row_id", "n")


_SQL_RANKS = """
b AS (SELECT query_id, vec_id AS chat_id, label, sim FROM s),
g AS (SELECT query_id, arg_min(sim, (-sim, chat_id)) AS gs, arg_min(chat_id, (-sim, chat_id)) AS gc FROM b WHERE query_id = label GROUP BY 1),
r AS (SELECT b.query_id, max(sim) AS top1, CASE WHEN any_value(gs) IS NOT NULL THEN count(*) FILTER (sim > gs OR (sim = gs AND chat_id < gc)) + 1 END AS rank
      FROM b LEFT JOIN g USING (query_id) GROUP BY b.query_id)"""


def _ranks(t: Tables):
    chats = vectors(t).withColumn("chat_id", F.col("row_id"))
    gold = chats.select(F.col("label").cast("bigint").alias("query_id"), "chat_id")
    return evaluation.gold_ranks(chats, questions(t), gold)


@query(f"WITH {_SQL_Q}, {_SQL_RANKS} SELECT query_id, rank, round(top1, 6) AS top1 FROM r")
def gold_ranks(t: Tables):
    return _ranks(t).select("query_id", F.col("rank").cast("bigint").alias("rank"), F.round("top1", 6).alias("top1"))


@query(
    f"""WITH {_SQL_Q}, {_SQL_RANKS}
    SELECT round(avg((rank <= 5)::DOUBLE) FILTER (rank IS NOT NULL), 6) AS recall_5, round(avg((rank <= 8)::DOUBLE) FILTER (rank IS NOT NULL), 6) AS recall_8,
      round(avg((rank <= 10)::DOUBLE) FILTER (rank IS NOT NULL), 6) AS recall_10, round(avg(1.0::DOUBLE / rank), 6) AS mrr,
      round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END) FILTER (rank IS NOT NULL), 6) AS mrr_10,
      count(rank) AS n_pos, round(avg(top1) FILTER (rank IS NOT NULL), 6) AS pos_top1, round(avg(top1) FILTER (rank IS NULL), 6) AS neg_top1,
      round(avg(top1) FILTER (rank IS NOT NULL) - avg(top1) FILTER (rank IS NULL), 6) AS margin FROM r"""
)
def recall_mrr(t: Tables):
    out = evaluation.score_ranks(_ranks(t), F.col("rank").isNotNull())
    return out.select(*[F.col(c) if c == "n_pos" else F.round(c, 6).alias(c) for c in out.columns])


@query(
    f"""WITH {_SQL_Q}, {_SQL_RANKS},
    v AS (SELECT 'chunk' AS label, * FROM r UNION ALL SELECT 'doubled', query_id, top1, rank * 2 FROM r),
    c AS (SELECT label, round(avg((rank <= 8)::DOUBLE) FILTER (rank IS NOT NULL), 6) AS recall_8, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM v GROUP BY 1)
    SELECT label, recall_8, mrr, (recall_8 < 0.9)::BIGINT AS needs_vendor FROM c ORDER BY recall_8 DESC, mrr DESC, label LIMIT 1"""
)
def embedder_winner(t: Tables):
    """Best of two variants by recall and MRR (the second variant has doubled ranks)."""
    base = _ranks(t)
    both = base.withColumn("label", F.lit("chunk")).unionByName(base.withColumn("rank", F.col("rank") * 2).withColumn("label", F.lit("doubled")))
    card = evaluation.score_ranks(both, F.col("rank").isNotNull(), ["label"])
    card = card.select("label", F.round("recall_8", 6).alias("recall_8"), F.round("mrr", 6).alias("mrr"))
    return evaluation.best_embedder(card).withColumn("needs_vendor", F.col("needs_vendor").cast("bigint"))


@query(
    f"""WITH {_SQL_Q}, {_SQL_CAPPED}, g AS (SELECT DISTINCT vec_id, label FROM e)
    SELECT query_id AS id, bool_or(query_id = label)::BIGINT AS gold_hit FROM h JOIN g USING (vec_id) GROUP BY 1"""
)
def answer_gold_hit(t: Tables):
    """Whether the retrieved chunks of each question touch its gold label."""
    hits = retrieval.retrieve(vectors(t), questions(t)).join(vectors(t).select("row_id", "label"), "row_id")
    return hits.groupBy(F.col("query_id").alias("id")).agg(
        F.bool_or(F.col("query_id") == F.col("label")).cast("bigint").alias("gold_hit")
    )


@query(
    """WITH d AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT a.vec_id, a.v, b.v AS w FROM d a JOIN d b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_cosine_similarity(v, w), 6) AS cos, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM m"""
)
def vector_math(t: Tables):
    """Cosine with the following vector, and the norm."""
    a = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cos"), F.round(V.norm(F.col("v")), 6).alias("norm")
    )


@query(
    f"""WITH {_SQL_Q}, {_SQL_CAPPED},
    n AS (SELECT query_id, chat_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS n FROM h GROUP BY 1, 2),
    b AS (SELECT query_id, rank, '[' || n || '] chat ' || chat_id || ' (' || day || ') chars 0-64' || E'\\n' || 'label ' || label AS block
          FROM h JOIN n USING (query_id, chat_id) JOIN (SELECT vec_id, label, day FROM e) USING (vec_id))
    SELECT query_id, md5('Question: q' || query_id || E'\\n\\nExcerpts, newest weighted:\\n\\n' || string_agg(block, E'\\n\\n' ORDER BY rank)
      || E'\\n\\nAnswer from these excerpts only, citing [n].') AS prompt_md5 FROM b GROUP BY query_id"""
)
def prompt_blocks(t: Tables):
    """Cited prompt of each question."""
    v = vectors(t)
    meta = v.select(
        "row_id", F.concat(F.lit("chat "), "chat_id").alias("title"), "update_date", F.lit(0).alias("start"), F.lit(64).alias("end"),
        F.concat(F.lit("label "), "label").alias("text"),
    )
    q = questions(t)
    asked = q.select("query_id", F.concat(F.lit("q"), "query_id").alias("question"))
    return retrieval.prompts(asked, retrieval.retrieve(v, q), meta).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query(
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n, label LIMIT 1),
    g AS (SELECT vec_id, label FROM embeddings WHERE label = (SELECT label FROM c)),
    o AS (SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM g) ORDER BY md5('7:' || vec_id), vec_id LIMIT 100)
    SELECT * FROM g UNION ALL SELECT * FROM o"""
)
def scope_sample(t: Tables):
    """Evaluation scope: all vectors of the smallest label and 100 hashed distractors."""
    least = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "label").limit(1)
    gold = t.embeddings.join(least.select("label"), "label", "left_semi").select("vec_id")
    return evaluation.scope(t.embeddings.select("vec_id", "label"), gold, "vec_id", 100, seed=7)
