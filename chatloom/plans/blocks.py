"""Ordered computations that never put a whole key into one task.

A plain window ``partitionBy(key).orderBy(pos)`` sends every row of a key to one
task, so one key holding a third of the table stalls the job. Here the ordered
axis is cut into blocks: even ones, whose edges Spark samples from the rows (see
``even``), or ones that the caller names as a column, monotone in the order. Totals
of the blocks are pre-aggregated with map-side combine; the window over *blocks* is
small, and the window over rows is partitioned by (key, block).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.session import cut

BLOCK = "_blk"
#: Rows that a block should hold where blocks are made even.
EVEN_ROWS = 1 << 17
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def int_block(col: Column, width: int = 65536) -> Column:
    """Block number of an integer position."""
    return F.floor(col / F.lit(width)).cast("bigint")


def time_block(ts: Column, seconds: int = 86400) -> Column:
    """Block number of a timestamp (any zone-less or zoned timestamp, read as UTC)."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(seconds)).cast("bigint")


def even(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rows: int = EVEN_ROWS) -> DataFrame:
    """Add ``BLOCK``: stretches of the order (keys, order) that hold about ``rows`` rows each.

    Whatever the keys and however crowded a stretch of time is, no block is much larger
    than the others: its edges are quantiles that Spark samples for a range partitioning.
    The rows are written once with their block, so that every later read sees the same
    edges. Rows that are equal in keys and order stay in one block; end the order with a
    unique column.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order])
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id().cast("bigint")))


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column | None) -> DataFrame:
    return even(df, keys, order) if block is None else df.withColumn(BLOCK, block)


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on equal keys, null equal to null."""
    named = right.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return left.join(named, same, "left").drop(*[f"_k_{c}" for c in on])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column | None,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates ``name -> (sum|max|min, column)`` along ``order``.

    ``block`` must be monotone in ``order`` within a key; None makes even ones. Exclusive running sums
    start at 0; exclusive running extremes start at null.
    """
    keys = list(keys)
    base = _placed(df, keys, order, block)
    for name, (_, col) in values.items():
        base = base.withColumn(f"_v_{name}", col)
    totals = base.groupBy(*keys, BLOCK).agg(
        *[_AGG[how](f"_v_{name}").alias(f"_t_{name}") for name, (how, _) in values.items()]
    )
    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        BLOCK,
        *[_AGG[how](f"_t_{name}").over(over_blocks).alias(f"_o_{name}") for name, (how, _) in values.items()],
    )
    end = 0 if inclusive else -1
    in_block = (
        Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    joined = _null_safe(base, before, [*keys, BLOCK])
    out = []
    for name, (how, _) in values.items():
        local, carried = _AGG[how](f"_v_{name}").over(in_block), F.col(f"_o_{name}")
        if how == "sum":
            merged = F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            pick = F.greatest if how == "max" else F.least
            merged = pick(carried, local)
        out.append(merged.alias(name))
    return joined.select(*df.columns, *out)


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before, in one global order of any type.

    Rows are range-sorted into even parts and written once; each part is summed by
    itself and shifted by the parts before it, which are one row each.
    """
    held = cut(df.withColumn("_v", value).orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("_part").agg(F.sum("_v").alias("_t"))
    # One row per part of the session's shuffles.
    starts = totals.select("_part", F.coalesce(F.sum("_t").over(before.orderBy("_part")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_v").over(before.partitionBy("_part").orderBy(*order)), F.lit(0))
    return held.withColumn("_inside", inside).join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    carry: Mapping[str, Column],
) -> DataFrame:
    """Add the values ``carry`` had on the previous row of the key (null on the first)."""
    keys = list(keys)
    base = _placed(df, keys, order, block).withColumn(
        "_row", F.struct(*[c.alias(n) for n, c in carry.items()])
    )
    last = base.groupBy(*keys, BLOCK).agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, BLOCK, F.lag("_last").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_prev_block")
    )
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    joined = _null_safe(base, carried, [*keys, BLOCK]).withColumn(
        "_prev", F.coalesce(F.lag("_row").over(in_block), F.col("_prev_block"))
    )
    return joined.select(*df.columns, *[F.col("_prev")[n].alias(n) for n in carry])


def streaks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None, hit: Column, name: str
) -> DataFrame:
    """Add ``name``: how many rows in a row, up to and with this one, satisfy ``hit``.

    A block passes on the length of its open streak: its trailing hits, or the
    streak it was given plus all its rows when it has no miss at all.
    """
    keys = list(keys)
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def counted(rows: DataFrame) -> DataFrame:
        hits = F.sum("_hit").over(in_block)
        return rows.withColumn("_cum", hits).withColumn(
            "_base", F.max(F.when(F.col("_hit") == 0, F.col("_cum"))).over(in_block)
        )

    base = _placed(df, keys, order, block).withColumn("_hit", hit.cast("bigint"))
    ends = counted(base.select(*keys, BLOCK, *order, "_hit")).groupBy(*keys, BLOCK).agg(
        F.max("_cum").alias("_all"), F.max("_base").alias("_upto")
    )
    by_key = Window.partitionBy(*keys).orderBy(BLOCK)
    grouped = ends.withColumn("_g", F.sum(F.col("_upto").isNotNull().cast("bigint")).over(by_key))
    open_end = F.sum(F.col("_all") - F.coalesce("_upto", F.lit(0))).over(Window.partitionBy(*keys, "_g").orderBy(BLOCK))
    carried = grouped.withColumn("_open", open_end).select(
        *keys, BLOCK, F.coalesce(F.lag("_open").over(by_key), F.lit(0)).alias("_given")
    )
    out = counted(_null_safe(base, carried, [*keys, BLOCK]))
    length = F.when(F.col("_base").isNull(), F.col("_given") + F.col("_cum")).otherwise(F.col("_cum") - F.col("_base"))
    return out.select(*df.columns, length.alias(name))


def ordered_join(items: Column, sep: str) -> Column:
    """Join ``array<struct<pos, text>>`` texts in ``pos`` order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def pack_text(
    df: DataFrame,
    key: str,
    pos: Sequence[str] | str,
    text: str,
    sep: str,
    part_chars: int,
    block_width: int = 1024,
    block: Column | None = None,
) -> DataFrame:
    """Concatenate the texts of a key in order, as parts of about ``part_chars``.

    ``pos`` is an integer position, or several columns together with their ``block``.

    A key of any size becomes several bounded rows ``(key, part_no, n, text)``;
    joining the parts by ``sep`` in ``part_no`` order gives the whole text.
    """
    order = [pos] if isinstance(pos, str) else list(pos)
    placed = running(
        df.select(key, *order, F.col(text).alias("text")),
        [key],
        order,
        int_block(F.col(order[0]), block_width) if block is None else block,
        {"_before": ("sum", F.length("text") + F.lit(len(sep)))},
        inclusive=False,
    )
    return (
        placed.withColumn("part_no", F.floor(F.col("_before") / F.lit(part_chars)).cast("bigint"))
        .groupBy(key, "part_no")
        .agg(
            F.count(F.lit(1)).alias("n"),
            ordered_join(F.collect_list(F.struct(F.struct(*order).alias("pos"), "text")), sep).alias("text"),
        )
    )
