"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chatloom.session import shared_dir

#: Words are runs of anything but these; the same set is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows is recomputed from files that survive the loss
    of an executor. The folder is the cluster's own scratch space and is cleaned
    with it, as a lazily read result may still need the files.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of a text's words."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for exchanges that must not be merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows 0, 1, ... in an order without sending all rows to one task.

    Rows are range-sorted and written once; each sorted part is numbered by itself
    and shifted by the sizes of the parts before it (one row per part).
    """
    part, local = "_part", "_local"
    held = stored(df.orderBy(*order).withColumn(part, F.spark_partition_id()))
    sizes = held.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return (
        held.withColumn(local, inside).join(starts, part)
        .withColumn(name, F.col("_start") + F.col(local)).drop(part, local, "_start")
    )


def arrow_batches(spark) -> None:
    """Bound what one Arrow batch carries, as a few texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) of every end of the edges (a, b): the smallest id reachable.

    Alternating large-star and small-star steps: every node is re-linked to the
    smallest id around it until each component is a star. A step aggregates and
    joins; no neighbour list is ever built.
    """
    a, b = F.col("a"), F.col("b")
    links = stored(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first()
        if state == seen or not state[0]:
            return links.select(a.alias("doc"), b.alias("component")).union(links.select(b, b)).distinct()
        seen = state
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(a.alias("a"), F.col("low").alias("b")), F.struct(b.alias("a"), F.col("low").alias("b")))).alias("e"))
        links = stored(small.select("e.*").where(a != b).distinct())


def worker_cache() -> dict:
    """What this Python worker keeps for the tasks it runs one after the other.

    Functions reach a worker by value, with new globals for every task, so the dict
    hangs on a module of its own.
    """
    return sys.modules.setdefault("_chatloom_worker", types.ModuleType("_chatloom_worker")).__dict__


#: Bytes of a remembered entry beside its text and its value.
ENTRY = 150


class Memo:
    """Remembered bytes of texts in two generations: what is in use moves to the new one, the old one goes.

    Bounded by the bytes of keys and values; each generation takes half.
    """

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, keys: Iterable[str], work: Callable[[list[str]], list[bytes]]) -> Callable[[str], bytes]:
        """A look-up that knows all ``keys``; ``work`` is asked for those not remembered."""
        if self.size > self.most // 2:
            self.old, self.new, self.size = self.new, {}, 0
        new, old = self.new, self.old
        unknown = []
        for key in set(keys).difference(new):
            if (value := old.pop(key, None)) is None:
                unknown.append(key)
            else:
                new[key] = value
                self.size += len(key) + len(value) + ENTRY
        for key, value in zip(unknown, work(unknown) if unknown else ()):
            new[key] = value
            self.size += len(key) + len(value) + ENTRY
        return new.__getitem__
