"""Exact retrieval: dense, keyword and lexical, over query tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.functions import text as T
from chatloom.plans.pairing import meet, vector_bytes
from chatloom.session import cut

# Scores are rounded before ranking, so the order of additions cannot reorder ties.
DIGITS = 9


#: Bytes of one block of scores inside a task.
BLOCK_BYTES = 64 << 20


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def slices(rows: int, queries: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[slice, slice]]:
    """Cuts of a rows x queries matrix of doubles into blocks of bounded bytes."""
    tall = max(1, min(rows, block_bytes // 8))
    wide = max(1, block_bytes // (8 * tall))
    for i in range(0, rows, tall):
        for j in range(0, queries, wide):
            yield slice(i, min(i + tall, rows)), slice(j, min(j + wide, queries))


def _best(found: pd.DataFrame, pool: int) -> pd.DataFrame:
    ranked = found.sort_values(["query_id", "score", "row_id"], ascending=[True, False, True], kind="stable")
    return ranked.groupby("query_id", sort=False).head(pool)


def _floors(scores: np.ndarray, pool: int) -> np.ndarray:
    """Per column, the score that the ``pool`` best values reach."""
    n = len(scores)
    return np.partition(scores, n - pool, axis=0)[n - pool] if n > pool else np.full(scores.shape[1], -np.inf)


def _top_kernel(pool: int, best_per_chat: bool, block_bytes: int = BLOCK_BYTES):
    """Survivors of each batch: the ``pool`` best rows (or chats) per query.

    A block of scores is cut to its best before any row of a frame is made.
    """

    def kernel(batches: Iterator[pd.DataFrame], queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(queries):
            return
        q, q_ids = _unit(queries["qvec"]), queries["query_id"].to_numpy()
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values(["chat_id", "row_id"], kind="stable") if best_per_chat else batch
            unit, weight = _unit(batch["vec"]), batch["weight"].to_numpy(dtype="float64")
            rows, chats = batch["row_id"].to_numpy(), batch["chat_id"].to_numpy()
            for part, some in slices(len(batch), len(q), block_bytes // 4):
                sims = np.round(unit[part] @ q[some].T, DIGITS)
                scores = np.round(sims * weight[part, None], DIGITS)
                if best_per_chat:
                    mine = chats[part]
                    first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                    of = np.cumsum(np.concatenate(([0], mine[1:] != mine[:-1])))
                    tops = np.maximum.reduceat(scores, first, axis=0)
                    tops[tops < _floors(tops, pool)] = np.inf  # chats that cannot be among the best
                    keep = scores == tops[of]
                else:
                    keep = (scores > 0.0) & (scores >= _floors(scores, pool))
                i, j = np.nonzero(keep)
                new = pd.DataFrame({
                    "query_id": q_ids[some][j], "row_id": rows[part][i], "chat_id": chats[part][i], "sim": sims[i, j], "score": scores[i, j]})
                if held is not None:
                    new = pd.concat([held, new], ignore_index=True)
                if best_per_chat:
                    new = new.sort_values(["score", "row_id"], ascending=[False, True], kind="stable")
                    new = new.drop_duplicates(["query_id", "chat_id"])
                held = _best(new, pool)
        if held is not None and len(held):
            yield held

    return kernel


def _hits(chunks: DataFrame, queries: DataFrame, pool: int, best_per_chat: bool, **bounds) -> DataFrame:
    types = {**dict(chunks.dtypes), **dict(queries.dtypes)}
    schema = (
        f"query_id {types['query_id']}, row_id {types['row_id']}, chat_id {types['chat_id']}, sim double, score double"
    )
    data = chunks.select("row_id", "chat_id", "vec", "weight")
    return meet(
        data, queries.select("query_id", "qvec"), _top_kernel(pool, best_per_chat), schema, "row_id", "query_id",
        vector_bytes("vec"), vector_bytes("qvec"), **bounds)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 8,
    per_chat: int = 3,
    pool_factor: int = 4,
    **bounds,
) -> DataFrame:
    """Top ``k`` chunks per query by cosine times ``weight``, at most ``per_chat`` of one chat.

    ``chunks``: row_id, chat_id, vec, weight (recency; 1 for none). ``queries``:
    query_id, qvec. Every partition keeps its own pool, so only pools are shuffled.
    As the chat cap applies inside the pool, fewer than ``k`` rows can come back;
    a larger ``pool_factor`` widens the pool.
    """
    pool = k if per_chat <= 0 else max(k * pool_factor, k)
    order = [F.desc("score"), F.col("row_id")]
    by_query = Window.partitionBy("query_id").orderBy(*order)
    hits = _hits(chunks, queries, pool, best_per_chat=False, **bounds)
    hits = hits.withColumn("_p", F.row_number().over(by_query)).where(F.col("_p") <= pool)
    if per_chat > 0:
        by_chat = Window.partitionBy("query_id", "chat_id").orderBy(*order)
        hits = hits.withColumn("_c", F.row_number().over(by_chat)).where(F.col("_c") <= per_chat).drop("_c")
    return hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).drop("_p")


def rank_chats(chunks: DataFrame, queries: DataFrame, k: int, **bounds) -> DataFrame:
    """The ``k`` best chats per query, each by its best chunk.

    A chat of the global top k is among the top k of the partition that holds its
    best chunk, so k chats per partition are enough.
    """
    hits = _hits(chunks, queries, k, best_per_chat=True, **bounds)
    best = hits.groupBy("query_id", "chat_id").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "row_id")).alias("b")
    )
    order = Window.partitionBy("query_id").orderBy("b.neg", "b.row_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "chat_id", (-F.col("b.neg")).alias("score"), F.col("b.row_id").alias("row_id"), "rank")
    )


def lexical_rerank(hits: DataFrame, question: Column, text: Column) -> DataFrame:
    """Blend the score with the share of question words in the hit, and rank again."""
    blended = F.round(F.col("score") * (1 + T.lexical_overlap(question, text)), DIGITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("blended"), F.col("rank"))
    return hits.withColumn("blended", blended).withColumn("rerank", F.row_number().over(order))


def sources(hits: DataFrame) -> DataFrame:
    """Distinct chats of the hits, numbered by first appearance, with the first hit's row."""
    first = hits.groupBy("query_id", "chat_id").agg(F.min(F.struct("rank", "row_id")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.rank")
    return first.select("query_id", "chat_id", "f.row_id", F.row_number().over(order).alias("n"))


def prompts(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cited excerpt prompt and source list per question; hits are at most k per question."""
    numbered = hits.join(sources(hits).select("query_id", "chat_id", "n"), ["query_id", "chat_id"]).join(
        chunks.select("row_id", "title", "update_date", "start", "end", "text"), "row_id"
    )
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)"))
    span = F.concat(F.lit("chars "), F.col("start"), F.lit("-"), F.col("end"))
    head = F.concat(
        F.lit("["), F.col("n"), F.lit("] "), title, F.lit(" ("),
        F.coalesce(F.nullif("update_date", F.lit("")), F.lit("?")), F.lit(") "), span,
    )
    block = F.concat(head, F.lit("\n"), T.strip(F.col("text")))
    source = F.concat(
        F.lit("  ["), F.col("n"), F.lit("] "), title, F.lit(" · "),
        F.coalesce(F.nullif("update_date", F.lit("")), F.lit("—")), F.lit(" · id="), F.col("chat_id"), F.lit(" · "), span,
    )
    merged = numbered.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"),
        F.array_sort(F.collect_list(F.struct("n", "rank", source.alias("source")))).alias("sources"),
    )
    firsts = F.filter("sources", lambda s, i: (i == 0) | (s["n"] != F.get("sources", i - 1)["n"]))
    context = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return questions.join(merged, "query_id").select(
        "query_id",
        F.concat(
            F.lit("Question: "), F.col("question"), F.lit("\n\nExcerpts, newest weighted:\n\n"), context,
            F.lit("\n\nAnswer from these excerpts only, citing [n]."),
        ).alias("prompt"),
        F.array_join(F.transform(firsts, lambda s: s["source"]), "\n").alias("sources"),
    )


# --- keyword search -------------------------------------------------------


#: Pairs of a token and a word of which a copy goes to every task; more are joined by shuffling.
COPIED = 250_000


def word_hits(words: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """(word, doc_id) and ``more`` columns of every text that contains the word anywhere.

    A word is letters and digits only, so a text contains it exactly when one of its
    own tokens does. Distinct tokens are posted under their 4-grams; a word looks only
    under the one of its own grams that fewest tokens hold, and those are searched for it.
    """
    # The outer form adds no filter on the list, which would work it out a second time.
    tokens = docs.select("doc_id", *more, F.explode_outer(F.array_distinct(T.words(F.col("text")))).alias("token"))
    asked = words.select("word").distinct()
    # At most three numbers: words shorter than a gram are grams of their own.
    sizes = sorted(r["n"] for r in asked.select(F.least(F.length("word"), F.lit(GRAM)).alias("n")).distinct().collect() if r["n"])
    # Written once: read for the counts of grams and for the look-up.
    postings = cut(tokens.select("token").distinct().select("token", F.explode_outer(_grams(F.col("token"), sizes)).alias("gram")))
    common = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.length("word"), F.lit(GRAM))
    own = asked.select("word", F.explode(F.filter(_grams(F.col("word"), sizes), lambda g: F.length(g) == size)).alias("gram"))
    rarest = own.join(common, "gram").groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    found = cut(postings.join(rarest, "gram").where(F.contains("token", "word")).select("token", "word"))
    # Measured: a small list spares the shuffle of all tokens of all texts.
    found = F.broadcast(found) if found.count() <= COPIED else found
    return tokens.join(found, "token").select("word", "doc_id", *more).distinct()


#: Letters in a gram of a posting.
GRAM = 4


def _grams(token: Column, sizes: list[int]) -> Column:
    """Distinct stretches of the given lengths; a look-ahead matches at every place."""
    found = [F.regexp_extract_all(token, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


#: Newest texts that all words are looked for in before the others.
NEWEST = 4_096


def _newest_first(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``NEWEST`` newest rows (with those equal to the last of them), and all others."""
    order = [F.desc("update_date"), F.col("doc_id")]
    last = docs.select("update_date", "doc_id").orderBy(*order).limit(NEWEST).orderBy(F.asc("update_date"), F.desc("doc_id")).first()
    if last is None:
        return docs, docs.limit(0)
    day, same = F.col("update_date"), F.col("doc_id") <= F.lit(last["doc_id"])
    if last["update_date"] is None:
        new = day.isNotNull() | same
    else:
        new = F.coalesce((day > F.lit(last["update_date"])) | (day == F.lit(last["update_date"])) & same, F.lit(False))
    return docs.where(new), docs.where(~new)


def _newest_hits(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest rows of each word, with their place ``at``."""
    newest = Window.partitionBy("word").orderBy(F.desc("update_date"), "doc_id", "row")
    return hits.select("word", "doc_id", "update_date", "row").withColumn("at", F.row_number().over(newest)).where(F.col("at") <= k)


def _top_hits(words: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return _newest_hits(word_hits(words, docs, "update_date", "row"), k)


def keyword_fallback(questions: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """Up to ``k`` documents per question from its salient words, longest word first.

    ``questions``: query_id, question. ``docs``: doc_id, update_date, text. Within
    a word newer documents come first; a document keeps its first place. The newest are
    searched for all words, all others only for the words that are still short of ``k``.
    """
    asked = questions.select("query_id", F.posexplode(T.salient_words(F.col("question"))).alias("word_no", "word"))
    words = cut(asked.select("word").distinct())
    # Rows of one id are told apart: each takes a place of its own.
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "update_date", "text", F.monotonically_increasing_id().alias("row"))
    newest, older = _newest_first(rows)
    hits = cut(_top_hits(words, newest, k))
    # Words with enough hits among the newest are done; the others are rare, so few hits are left in all other texts.
    full = hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    top = _newest_hits(hits.union(_top_hits(words.join(full, "word", "left_anti"), older, k)), k)
    first = asked.join(top, "word").groupBy("query_id", "doc_id").agg(F.min(F.struct("word_no", "at", "word")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.word_no", "f.at")
    return (
        first.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k)
        .select("query_id", "n", "doc_id", F.col("f.word").alias("word"))
    )
