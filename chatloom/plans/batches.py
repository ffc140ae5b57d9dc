"""Next-fit batches along an order, for keys of any size, without walking a key in one task.

A batch's end depends on where it began, so a plain fold would walk all rows of a key
one after the other. Here the order is cut into cells of a fixed number of rows. Where a
cell's first batch may begin is one of few places: a batch holds at most ``size`` items,
so the last one of the cell before ends within the first ``size`` rows. A cell is summed
up as a table of jumps: for each such place, where the next cell's first batch begins,
and how many batches the cell opens. Jumps of neighbouring cells compose, so cells are
summed up in a tree of ``FAN`` children; on the way down each cell learns its true
first place, and its rows their batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.plans.blocks import BLOCK, even, running
from chatloom.session import cut

#: Rows in a cell (more if a batch may hold more), and children of a node of the tree.
CELL, FAN = 256, 256
NONE = -1


def _walk(needs: Column, first: Column, width: int, size: int, budget: int, keep_starts: bool) -> Column:
    """Batches of a cell whose first one begins at ``first``: where the next cell's begins, how many open, and where.

    ``needs`` goes on ``size`` rows into the next cell.
    """
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("opened"), F.lit(NONE).alias("exit"),
        F.array().cast("array<int>").alias("starts"))

    def state(n: Column, used: Column, opened: Column, exit: Column, starts: Column) -> Column:
        return F.struct(n.alias("n"), used.alias("used"), opened.alias("opened"), exit.alias("exit"), starts.alias("starts"))

    def step(acc: Column, i: Column) -> Column:
        need = F.get(needs, i)
        opens = (acc["n"] == 0) | (acc["n"] >= size) | (acc["used"] + need > budget)
        begun = F.array_append(acc["starts"], i) if keep_starts else acc["starts"]
        return (
            F.when((first < 0) | (i < first) | (acc["exit"] >= 0), acc)
            .when(opens & (i >= width), state(acc["n"], acc["used"], acc["opened"], i - width, acc["starts"]))
            .when(opens, state(F.lit(1), need, acc["opened"] + 1, acc["exit"], begun))
            .otherwise(state(acc["n"] + 1, acc["used"] + need, acc["opened"], acc["exit"], acc["starts"]))
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(needs) - 1), start, step)


def _composed(tables: Column, size: int) -> Column:
    """The jumps of neighbouring cells, one after the other."""
    begin = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda e: F.struct(e.alias("exit"), F.lit(0).cast("bigint").alias("opened")))

    def step(held: Column, table: Column) -> Column:
        return F.transform(held, lambda x: F.when(x["exit"] < 0, x).otherwise(
            F.struct(F.get(table, x["exit"])["exit"].alias("exit"), (x["opened"] + F.get(table, x["exit"])["opened"]).alias("opened"))))

    return F.aggregate(tables, begin, step)


def _entries(tables: Column, first: Column, before: Column) -> Column:
    """Where each child's first batch begins, and the batches opened before it."""
    start = F.struct(first.alias("first"), before.alias("before"), F.array().cast("array<struct<first:int,before:bigint>>").alias("out"))

    def step(acc: Column, table: Column) -> Column:
        jump = F.get(table, acc["first"])
        out = F.array_append(acc["out"], F.struct(acc["first"].alias("first"), acc["before"].alias("before")))
        return F.when(acc["first"] < 0, F.struct(acc["first"].alias("first"), acc["before"].alias("before"), out.alias("out"))).otherwise(
            F.struct(jump["exit"].alias("first"), (acc["before"] + jump["opened"]).alias("before"), out.alias("out")))

    return F.aggregate(tables, start, step)["out"]


def next_fit(work: DataFrame, keys: Sequence[str], order: Sequence[str], need: Column, size: int, budget: int, name: str = "batch") -> DataFrame:
    """Add the batch of each row, counted from 0 in its key: a batch closes at ``size`` rows or before ``need`` adds up to more than ``budget``.

    A row that needs more than the budget is a batch of its own. Rows that share key and
    order share a block of the range partitioning; end the order with a unique column.
    """
    keys, width = list(keys), max(CELL, size)
    placed = even(work.withColumn("_need", need.cast("bigint")), keys, order)
    placed = running(placed, keys, order, F.col(BLOCK), {"_pos": ("sum", F.lit(1).cast("bigint"))}, inclusive=False)
    rows = cut(placed.drop(BLOCK).withColumn("_cell", F.floor(F.col("_pos") / width).cast("bigint")).withColumn("_off", (F.col("_pos") % width).cast("int")))

    own = F.struct(F.col("_cell").alias("cell"), F.col("_off").alias("off"))
    ahead = F.struct((F.col("_cell") - 1).alias("cell"), (F.col("_off") + width).alias("off"))
    seen = rows.select(*keys, "_need", F.explode(F.when((F.col("_off") < size) & (F.col("_cell") > 0), F.array(own, ahead)).otherwise(F.array(own))).alias("c"))
    needs = F.transform(F.array_sort(F.collect_list(F.struct("c.off", "_need"))), lambda x: x["_need"])
    cells = seen.groupBy(*keys, F.col("c.cell").alias("cell")).agg(needs.alias("needs"))
    jumps = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda e: _walk(F.col("needs"), e, width, size, budget, False))
    cells = cut(cells.withColumn("table", F.transform(jumps, lambda x: F.struct(x["exit"].alias("exit"), x["opened"].alias("opened")))))

    # Up: tables of cells become tables of groups of cells, until every key has one.
    levels, last = [], cells.agg(F.max("cell")).first()[0] or 0
    below = cells.select(*keys, "cell", "table")
    while True:
        gathered = F.transform(F.array_sort(F.collect_list(F.struct("cell", "table"))), lambda x: x["table"])
        groups = cut(below.groupBy(*keys, F.floor(F.col("cell") / FAN).cast("bigint").alias("cell")).agg(gathered.alias("tables")))
        levels.append(groups)
        last //= FAN
        if not last:
            break
        below = groups.select(*keys, "cell", _composed(F.col("tables"), size).alias("table"))
    # Down: every key begins with a batch on its first row.
    known = levels[-1].select(*keys, "cell", F.lit(0).alias("first"), F.lit(0).cast("bigint").alias("before"))
    for groups in reversed(levels):
        met = _same(groups, known, [*keys, "cell"])
        known = met.select(*keys, "cell", F.posexplode(_entries(F.col("tables"), F.col("first"), F.col("before")))).select(
            *keys, (F.col("cell") * FAN + F.col("pos")).alias("cell"), "col.first", "col.before")
    begun = _same(cells.drop("table"), known, [*keys, "cell"]).select(
        *keys, F.col("cell").alias("_cell"), F.col("before").alias("_before"), _walk(F.col("needs"), F.col("first"), width, size, budget, True)["starts"].alias("_starts"))
    opened = F.size(F.filter("_starts", lambda s: s <= F.col("_off")))
    return _same(rows, begun, [*keys, "_cell"]).select(*work.columns, (F.col("_before") + opened - 1).alias(name))


def _same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal columns, null equal to null."""
    named = right.select(*[F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return left.join(named, same).drop(*[f"_j_{c}" for c in on])
