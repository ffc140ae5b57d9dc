"""Mixing sources to target weights by entropy balancing, native Spark only.

Among all document rates between 0 and ``max_repeat`` whose expected words meet a
source's target, the ones closest to 1 in relative entropy are exponentially
tilted: rate = min(max_repeat, exp(b * size)), with one dual variable b per source.
The dual is convex; its Newton iterations are aggregates over a histogram
(source, size, documents) that is made once. Newton steps are kept inside a
shrinking bracket, so they always converge.

Rates become copies without chance: cumulative rounding along falling sizes fixes
the copies of each (source, size) cell, a bounded fold over the small sizes removes
the words still missing or too many, and a cell's copies are dealt evenly over its
documents by position. Cells of any size are cut into blocks, so a source or a
size that holds a third of all rows is never one task. Sums are decimals: reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, last
in order; a source without words has target 0 and takes nothing; rows that repeat an
id are documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.llm.common import ranked, stored, text_of, words

#: Sizes up to this take part in the last correction; a source has no more cells of them.
SMALL = 4096
#: Documents of one cell that are numbered together.
BLOCK = 512
TOLERANCE = 1e-7


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Add ``sid`` (place of the source), ``weight`` and ``target`` to (source, source_size).

    Sources in code-point order, null last, take the weights in turn. A target stops
    at ``max_repeat`` times its source; the excess is shared again by weight. Each
    round is one aggregate; the level only rises, so the rounds end.
    """
    order = [F.col("source").asc_nulls_last()]
    placed = stored(
        ranked(sizes, order, "sid")
        .withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights)).cast("int")).cast("long")))
    cap = F.col("source_size") * max_repeat
    total = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = cap.cast("double") <= F.col("weight") * F.lit(level)
        row = placed.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, 1).otherwise(0))).first()
        if not row[1] or row[2] == full:
            break
        full, level = row[2], (total - (row[0] or 0)) / row[1]
    aim = F.when(cap.cast("double") <= F.col("weight") * F.lit(level), cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return placed.withColumn("target", aim)


def _rate(size: Column, tilt: Column, max_repeat: int) -> Column:
    """min(max_repeat, exp(tilt * size)); the exponent is cut first so that it cannot overflow."""
    return F.when(tilt.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(float(max_repeat)), F.exp(F.least(tilt * size, F.lit(math.log(max_repeat) + 1)))))


def tilts(cells: DataFrame, aims: DataFrame, max_repeat: int = 3, steps: int = 80) -> DataFrame:
    """The dual variable ``tilt`` of each source, by Newton iterations over the cells.

    ``cells`` has (sid, size, docs), ``aims`` (sid, source_size, target). A null tilt takes nothing.
    """
    top = math.log(max_repeat)
    goal, size = F.col("target"), F.col("source_size").cast("double")
    ratio = goal / F.nullif(size, F.lit(0.0))
    settled = (goal <= 0) | (size <= 0) | (ratio >= max_repeat * (1 - 1e-12))
    state = stored(aims.select(
        "sid", "target",
        # Sizes are 1 at least, which bounds the dual on both sides.
        F.when(ratio < 1, F.log(ratio)).otherwise(0.0).alias("lo"), F.when(ratio <= 1, F.lit(0.0)).otherwise(top).alias("hi"),
        F.when(settled & (goal > 0) & (size > 0), F.lit(top)).when(~settled, F.lit(0.0)).alias("tilt"), settled.alias("done"),
    ))
    n, m, b = F.col("size"), F.col("docs"), F.col("tilt")
    for _ in range(steps):
        rate = _rate(n, b, max_repeat)
        exact = lambda x: F.sum(x.cast("decimal(38,8)")).cast("double")
        fixed = [F.first(c).alias(c) for c in ("target", "lo", "hi", "tilt")]
        got = cells.join(state.where(~F.col("done")), "sid").groupBy("sid").agg(
            *fixed, exact(m * n * rate).alias("words"),
            exact(F.when(rate < max_repeat, m * n * n * rate).otherwise(0.0)).alias("slope"))
        low = F.col("words") < F.col("target")
        lo, hi = F.when(low, b).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(b)
        newton = b + F.log(F.col("target") / F.col("words")) * F.col("words") / F.nullif(F.col("slope"), F.lit(0.0))
        moved = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        hit = F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")
        moving = got.select("sid", "target", lo.alias("lo"), hi.alias("hi"), F.when(hit, b).otherwise(moved).alias("tilt"), hit.alias("done"))
        state = stored(state.where("done").unionByName(moving))
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("sid", "tilt")


def _copies_per_cell(cells: DataFrame, aims: DataFrame, solved: DataFrame, max_repeat: int) -> DataFrame:
    """(sid, size, docs, rate, total): whole copies of each cell, in sum close to the target."""
    n, m = F.col("size"), F.col("docs")
    rated = cells.join(solved, "sid").withColumn("rate", _rate(n, F.col("tilt"), max_repeat)).drop("tilt")
    # A source has no more cells than sizes, however many documents it holds.
    falling = Window.partitionBy("sid").orderBy(n.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = (m * F.col("rate")).cast("decimal(38,9)")
    upto = F.sum(share).over(falling)
    half = F.lit(0.5).cast("decimal(2,1)")
    total = F.greatest(F.lit(0), F.least(m * max_repeat, (F.floor(upto + half) - F.floor(upto - share + half)).cast("long")))
    first = stored(rated.withColumn("total", total))
    missing = first.groupBy("sid").agg(F.sum(n * F.col("total")).alias("_now"))
    small = first.where((n > 0) & (n <= SMALL)).groupBy("sid").agg(
        F.sort_array(F.collect_list(F.struct(n.alias("n"), m.alias("m"), F.col("total").alias("k"))), asc=False).alias("_cells"))
    start = F.struct((F.col("target") - F.col("_now")).alias("left"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("moves"))

    def step(acc: Column, cell: Column) -> Column:
        # F.round is half up; a cell gives or takes what it can.
        more = F.greatest(-cell["k"], F.least(cell["m"] * max_repeat - cell["k"], F.round(acc["left"] / cell["n"]).cast("long")))
        moves = F.when(more != 0, F.array_append(acc["moves"], F.struct(cell["n"].alias("size"), more.alias("more")))).otherwise(acc["moves"])
        return F.struct((acc["left"] - more * cell["n"]).alias("left"), moves.alias("moves"))

    folded = small.join(missing, "sid").join(aims.select("sid", "target"), "sid").select("sid", F.aggregate("_cells", start, step)["moves"].alias("moves"))
    moves = folded.select("sid", F.inline("moves"))
    return first.join(moves, ["sid", "size"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0))).drop("more")


def mix(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3,
) -> DataFrame:
    """Per row: id, source, size, source_size, target, rate and ``copies`` (0 to ``max_repeat``)."""
    rows = stored(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.size(words(text_of(text))).cast("long").alias("size")))
    by_size = rows.groupBy("source", "size").agg(F.count("*").alias("docs"))
    aims = stored(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, share, max_repeat))
    cells = stored(by_size.join(aims.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "docs"))
    dealt = stored(_copies_per_cell(cells, aims, tilts(cells, aims, max_repeat), max_repeat))

    named = rows.join(aims.select(F.col("source").alias("_s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("docs") / BLOCK)).alias("block")
    placed = stored(named.join(dealt, ["sid", "size"]).select("*", block))
    cell, part = ["sid", "size"], ["sid", "size", "block"]
    before = F.sum("_n").over(Window.partitionBy(*cell).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy(*part).agg(F.count("*").alias("_n")).select(*part, F.coalesce(before, F.lit(0)).alias("_first"))
    at = F.col("_first") + F.row_number().over(Window.partitionBy(*part).orderBy("id")) - 1
    # floor((at + 1) * total / docs) - floor(at * total / docs), in whole numbers.
    upto = lambda k: F.floor((k.cast("decimal(20,0)") * F.col("total").cast("decimal(18,0)")) / F.col("docs"))
    return (
        placed.join(offsets, part).withColumn("_at", at)
        .select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "rate",
                (upto(F.col("_at") + 1) - upto(F.col("_at"))).cast("int").alias("copies"))
    )


def repeat_rows(docs: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. The caller's columns travel in one struct, so no name clashes."""
    held = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
    sized = held.select("number", F.col("row")[source].alias("source"), F.col("row")[text].alias("text"))
    chosen = mix(sized, id="number", source="source", text="text", **options).where("copies > 0").select("number", "copies")
    repeated = held.join(chosen, "number").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
