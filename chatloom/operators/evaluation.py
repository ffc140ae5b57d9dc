"""Evaluate retrieval and answers against labelled batteries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.banks import NOT_FOUND, NOT_FOUND_PHRASES, REFUSAL_CUES
from chatloom.functions import vectors as V
from chatloom.operators.retrieval import BLOCK_BYTES, DIGITS, _unit, slices
from chatloom.plans.pairing import meet, vector_bytes
from chatloom.session import cut

KS = (5, 8, 10)


def scope(records: DataFrame, gold: DataFrame, key: str, distractors: int | None, seed: int = 0) -> DataFrame:
    """All gold chats, plus all others or a fixed pseudo-random sample of them (by md5 of seed and key)."""
    wanted = gold.select(key).distinct()
    others = records.join(wanted, key, "left_anti")
    if distractors is not None:
        drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
        others = others.orderBy(drawn, key).limit(distractors)
    return records.join(wanted, key, "left_semi").unionByName(others)


def _rank_kernel(block_bytes: int = BLOCK_BYTES):
    """Per query: the chats of a stream that outrank the best gold chat, as a count, and the best score.

    Rows come sorted by chat; a chat that goes on in the next batch is counted once.
    """

    def kernel(batches: Iterator[pd.DataFrame], queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(queries):
            return
        q, ids = _unit(queries["qvec"]), queries["query_id"].to_numpy()
        floors, rows0 = queries["gold_score"].to_numpy(dtype="float64"), queries["gold_row"].to_numpy(dtype="float64")
        n_above, top1 = np.zeros(len(q), np.int64), np.full(len(q), -np.inf)
        open_chat, open_above = None, np.zeros(len(q), bool)
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("chat_id", kind="stable")
            unit, rows, chats = _unit(batch["vec"]), batch["row_id"].to_numpy(), batch["chat_id"].to_numpy()
            last_above = np.zeros(len(q), bool)
            for part, some in slices(len(batch), len(q), block_bytes // 4):
                sims = np.round(unit[part] @ q[some].T, DIGITS)
                top1[some] = np.maximum(top1[some], sims.max(axis=0))
                # Unknown gold compares as false.
                above = (sims > floors[some]) | ((sims == floors[some]) & (rows[part, None] < rows0[some]))
                mine = chats[part]
                first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                per_chat = np.logical_or.reduceat(above, first, axis=0)
                # A block begins where the one above it ended, maybe within a chat.
                before = open_above[some] if part.start == 0 and mine[0] == open_chat else last_above[some] if part.start and mine[0] == chats[part.start - 1] else np.zeros(per_chat.shape[1], bool)
                n_above[some] += per_chat.sum(axis=0) - (per_chat[0] & before)
                last_above[some] = per_chat[-1] | (before if len(first) == 1 else False)
            open_chat, open_above = chats[-1], last_above
        yield pd.DataFrame({"query_id": ids, "n_above": n_above, "top1": top1})

    return kernel


def gold_ranks(chunks: DataFrame, queries: DataFrame, gold: DataFrame, **bounds) -> DataFrame:
    """Rank of the best gold chat per query and the best score of any chat.

    The rank is the number of chats that outrank gold plus one. One pass over the
    vectors returns a count and a best score per query and task; no pair leaves it.
    """
    types = {**dict(chunks.dtypes), **dict(queries.dtypes)}
    pairs = gold.join(chunks.select("chat_id", "row_id", "vec"), "chat_id").join(queries.select("query_id", "qvec"), "query_id")
    score = F.round(V.cosine(F.col("vec"), F.col("qvec")), DIGITS)
    best = pairs.groupBy("query_id").agg(F.min(F.struct((-score).alias("neg"), "row_id")).alias("g")).select(
        "query_id", (-F.col("g.neg")).alias("gold_score"), F.col("g.row_id").alias("gold_row")
    )
    asked = cut(queries.select("query_id", "qvec").join(best, "query_id", "left"))
    together = chunks.select("row_id", "chat_id", "vec").repartition("chat_id").sortWithinPartitions("chat_id")
    seen = meet(
        together,
        asked,
        _rank_kernel(),
        f"query_id {types['query_id']}, n_above bigint, top1 double",
        "chat_id",
        "query_id",
        vector_bytes("vec"),
        vector_bytes("qvec"),
        **bounds,
    ).groupBy("query_id").agg(F.sum("n_above").alias("n_above"), F.max("top1").alias("top1"))
    return asked.select("query_id", "gold_score").join(seen, "query_id", "left").select(
        "query_id",
        F.when(F.col("gold_score").isNotNull(), F.coalesce("n_above", F.lit(0)) + 1).alias("rank"),
        F.when(F.col("top1") > float("-inf"), F.col("top1")).otherwise(0.0).alias("top1"),
    )


def score_ranks(ranks: DataFrame, has_gold: Column, by: Sequence[str] = ()) -> DataFrame:
    """Recall, MRR (whole and cut at 10) and the top-1 margin between positives and negatives."""
    r = F.col("rank")
    pos = F.when(has_gold, F.lit(1))
    share = lambda cond: F.coalesce(F.avg(F.when(has_gold, F.coalesce(cond.cast("double"), F.lit(0.0)))), F.lit(0.0))
    reciprocal = F.coalesce(1.0 / r, F.lit(0.0))
    rows = ranks.groupBy(*by).agg(
        *[share(r <= k).alias(f"recall_{k}") for k in KS],
        F.coalesce(F.avg(F.when(has_gold, reciprocal)), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(has_gold, F.when(r <= 10, reciprocal).otherwise(0.0))), F.lit(0.0)).alias("mrr_10"),
        F.count(pos).alias("n_pos"),
        F.coalesce(F.avg(F.when(has_gold, F.col("top1"))), F.lit(0.0)).alias("pos_top1"),
        F.coalesce(F.avg(F.when(~has_gold, F.col("top1"))), F.lit(0.0)).alias("neg_top1"),
    )
    return rows.withColumn("margin", F.col("pos_top1") - F.col("neg_top1"))


def best_embedder(scorecard: DataFrame, floor: float = 0.9) -> DataFrame:
    """Winner by recall@8, then MRR; ``needs_vendor`` when even the winner misses the floor."""
    return (
        scorecard.orderBy(F.desc("recall_8"), F.desc("mrr"), "label")
        .limit(1)
        .withColumn("needs_vendor", F.col("recall_8") < floor)
    )


# --- answers --------------------------------------------------------------


def _any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def is_refusal(answer: Column) -> Column:
    return _any_phrase(F.lower(F.coalesce(answer, F.lit(""))), REFUSAL_CUES)


def is_not_found(answer: Column) -> Column:
    """Blank, the fixed sentence, or a short text with a refusal phrase."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", "")
    low = F.lower(text)
    exact = F.regexp_replace(low, r"\.+$", "") == NOT_FOUND.lower().rstrip(".")
    return (text == "") | exact | ((F.length(text) <= 240) & _any_phrase(low, NOT_FOUND_PHRASES))


def grade(kind: Column, needles: Column, expected: Column, answer: Column) -> Column:
    """Whether an answer passes: all needles, any needle, the first version, or a refusal."""
    a = F.coalesce(answer, F.lit(""))
    low = F.lower(a)
    has = lambda n: F.contains(low, F.lower(n))
    listed = F.coalesce(needles, F.array().cast("array<string>"))
    version = F.regexp_extract(a, r"\d+\.\d+", 0)
    passed = (
        F.when(kind == "refuse", is_refusal(a))
        .when(kind == "contains_all", F.forall(listed, has))
        .when(kind == "contains_any", F.exists(listed, has))
        .when(kind == "version_equals", ~is_refusal(a) & (version != "") & (version == expected))
    )
    return F.coalesce(passed, F.lit(False))


def looks_like_timeout(error: Column, elapsed_s: Column, budget_s: float) -> Column:
    low = F.lower(error)
    worded = F.contains(low, F.lit("timed out")) | F.contains(low, F.lit("timeout"))
    return worded if budget_s <= 0 else worded | (elapsed_s >= budget_s * 0.9)


def answer_rows(battery: DataFrame, answers: DataFrame, retrieved: DataFrame, budget_s: float) -> DataFrame:
    """One graded row per question.

    ``battery``: id, grade_type, needles, expected, gold_chat_ids. ``answers``: id,
    answer, error, route, elapsed_ms. ``retrieved``: id, chat_id.
    """
    gold = battery.select("id", F.explode("gold_chat_ids").alias("chat_id"))
    hit = gold.join(retrieved.select("id", "chat_id"), ["id", "chat_id"], "left_semi").select("id").distinct()
    late = F.col("elapsed_ms") > budget_s * 1000
    failed = F.col("error").isNotNull()
    timed_out = looks_like_timeout(F.col("error"), F.col("elapsed_ms") / 1000, budget_s)
    return (
        battery.join(answers, "id", "left")
        .join(hit.withColumn("_hit", F.lit(True)), "id", "left")
        .select(
            "id",
            "grade_type",
            "route",
            "elapsed_ms",
            (~failed & grade(F.col("grade_type"), F.col("needles"), F.col("expected"), F.trim("answer"))).alias("passed"),
            ((F.size("gold_chat_ids") <= 0) | F.coalesce("_hit", F.lit(False))).alias("gold_hit"),
            F.when(failed, timed_out).when(F.col("route") == "entity", F.lit(False)).otherwise(F.coalesce(late, F.lit(False))).alias("unusable"),
        )
    )


def answer_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("n_passed"),
        F.count_if("gold_hit").alias("n_gold"),
        F.count_if("unusable").alias("n_unusable"),
    )


def latency_summary(rows: DataFrame, by: Sequence[str], item: str, elapsed: str, unusable: Column) -> DataFrame:
    """Slowest item and the number over budget; the first item wins equal times."""
    worst = F.min(F.struct((-F.coalesce(elapsed, F.lit(0.0))).alias("neg"), F.col(item).alias("item")))
    return (
        rows.groupBy(*by)
        .agg(worst.alias("w"), F.count_if(unusable).alias("n_unusable"))
        .select(
            *by,
            (-F.col("w.neg")).alias("slowest"),
            F.col("w.item").alias("slowest_id"),
            "n_unusable",
            (F.col("n_unusable") == 0).cast("bigint").alias("usable"),
        )
    )


def query_log(log: DataFrame, last: int = 20) -> tuple[DataFrame, DataFrame]:
    """Totals over a query log and its ``last`` newest entries.

    ``log``: id, ts, route, question, elapsed_ms.
    """
    totals = log.agg(
        F.count(F.lit(1)).alias("served"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0.0)) / 1000).alias("answer_s"),
        F.max_by("route", F.struct("ts", "id")).alias("last_route"),
    )
    label = F.when(F.length("question") > 60, F.concat(F.substring("question", 1, 60), F.lit("…"))).otherwise(F.col("question"))
    newest = log.orderBy(F.desc("ts"), F.desc("id")).limit(last).withColumn("question", label)
    return totals, newest
