"""Incremental ingest: newest-wins upsert, tallies, ledgers and caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.plans.blocks import int_block, running


def _time(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0).cast("double"))


def newest_wins(batch: DataFrame, store: DataFrame | None, key: str, updated: str, order: str) -> DataFrame:
    """One row per key: the newest; stored rows, then earlier rows, win equal times.

    An aggregate, not a sort: a key repeated in a third of the rows is combined
    on the map side.
    """
    cols = batch.columns
    rows = batch.withColumn("_src", F.lit(1))
    if store is not None:
        rows = store.select(*cols).withColumn("_src", F.lit(0)).unionByName(rows)
    rest = [c for c in cols if c != key]
    rank = F.struct((-_time(updated)).alias("neg"), F.col("_src"), F.col(order).alias("ord"))
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def outcomes(batch: DataFrame, store: DataFrame | None, key: str, updated: str, order: str, width: int = 65536) -> DataFrame:
    """Status of each incoming row in source order: added, updated, skipped or no_id."""
    cols = batch.columns
    new = batch.where(F.col(key).isNotNull()).withColumn("_new", F.lit(True))
    if store is not None:
        old = store.select(key, F.col(updated), F.lit(-1).cast("bigint").alias(order), F.lit(False).alias("_new"))
        both = new.unionByName(old, allowMissingColumns=True)
    else:
        both = new
    seen = running(
        both, [key], [order], int_block(F.col(order), width), {"_best": ("max", _time(updated))}, inclusive=False
    )
    status = (
        F.when(F.col("_best").isNull(), F.lit("added"))
        .when(_time(updated) > F.col("_best"), F.lit("updated"))
        .otherwise(F.lit("skipped"))
    )
    done = seen.where("_new").select(*cols, status.alias("status"))
    return done.unionByName(batch.where(F.col(key).isNull()).withColumn("status", F.lit("no_id")))


def tallies(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"),
        n("added").alias("added"),
        n("updated").alias("updated"),
        n("skipped").alias("skipped"),
        n("added", "updated").alias("written"),
    )


def limited(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` new or changed rows in source order."""
    return rows.where(F.col("status").isin("added", "updated")).orderBy(order).limit(n)


def ledger_status(seen: Column, written: Column, skipped: Column) -> Column:
    s = F.coalesce(seen, F.lit(0))
    covered = F.coalesce(written, F.lit(0)) + F.coalesce(skipped, F.lit(0))
    return F.when(s <= 0, F.lit("empty")).when(covered >= s, F.lit("full")).otherwise(F.lit("partial"))


def ledger(runs: DataFrame, key: str, ts: str, stats: Sequence[str]) -> DataFrame:
    """Ledger from an append-only run log: first, last, run count and the last run's figures."""
    return (
        runs.groupBy(key)
        .agg(
            F.min(ts).alias("first_processed"),
            F.max(ts).alias("last_processed"),
            F.count(F.lit(1)).alias("runs"),
            F.max_by(F.struct(*stats), F.struct(ts, *stats)).alias("s"),
        )
        .select(key, "first_processed", "last_processed", "runs", *[F.col(f"s.{c}").alias(c) for c in stats])
    )


def unprocessed(files: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """Files whose fingerprint, and whose (name, size), the ledger does not know."""
    by_hash = ledger_rows.select("content_hash").distinct()
    by_name = ledger_rows.select("basename", "size").distinct()
    return files.join(by_hash, "content_hash", "left_anti").join(by_name, ["basename", "size"], "left_anti")


def cached_ids(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Conversation ids of files whose hash, name and size all match the cache."""
    return files.select("content_hash", "basename", "size").distinct().join(
        cache, ["content_hash", "basename", "size"]
    )


def changed_rows(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    from chatloom.operators.quality import upsert_report

    return upsert_report(existing, fresh, key).where("changed")
