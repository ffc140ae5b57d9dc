"""Meet every row of a large table with a query table, without a join of pairs.

Exact similarity search has to compare every stored row with every query. The
comparison runs inside Arrow batches and each batch returns only its survivors
(a per-query top list, a count), so pairs are never rows of a plan.

Both sides are cut by bytes. A query side that fits one cell is sent to all tasks;
beyond that the two sides form a grid of cells, each a bounded group of a cogroup.
One aggregate over the query side (and, for a grid, one over the data) decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of one side of a cell, whatever the width of its rows.
CELL_BYTES = 64 << 20

Kernel = Callable[[Iterator[pd.DataFrame], pd.DataFrame], Iterator[pd.DataFrame]]


def _cells(df: DataFrame, width: Column, cell_bytes: int) -> int:
    return max(1, math.ceil((df.agg(F.sum(width)).first()[0] or 0) / cell_bytes))


def vector_bytes(column: str) -> Column:
    """Bytes of a row that holds a vector of doubles and a few short columns."""
    return F.lit(8) * F.size(column) + 64


def meet(
    data: DataFrame,
    queries: DataFrame,
    kernel: Kernel,
    schema: str,
    data_id: str,
    query_id: str,
    data_width: Column,
    query_width: Column,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Survivors of ``kernel`` over all rows and queries; the result does not depend on the cells.

    A group of the grid is chosen by a hash of ``data_id``, so rows that a kernel must
    see together share it.
    """
    q_blocks = _cells(queries, query_width, cell_bytes)
    if q_blocks == 1:
        shared = data.sparkSession.sparkContext.broadcast(queries.toPandas())

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from kernel(batches, shared.value)

        return data.mapInPandas(whole, schema)

    d_blocks = _cells(data, data_width, cell_bytes)
    left = data.withColumn("_d", F.pmod(F.xxhash64(data_id), F.lit(d_blocks))).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    right = queries.withColumn("_q", F.pmod(F.xxhash64(query_id), F.lit(q_blocks)).cast("int")).withColumn(
        "_d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(d_blocks - 1).cast("bigint")))
    )

    def cell(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = list(kernel(iter([l]), r)) if len(l) and len(r) else []
        if found:
            return pd.concat(found, ignore_index=True)
        return pd.DataFrame({c.split()[0]: [] for c in schema.split(",")})

    return left.groupBy("_q", "_d").cogroup(right.groupBy("_q", "_d")).applyInPandas(cell, schema)
