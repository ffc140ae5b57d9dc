"""Exact deduplication: 128-bit content hashes, confirmed on the bytes.

Rows are grouped by (hash, text), so texts that only share a hash are told apart
by their bytes. Copies are combined before the shuffle, so a group of any size
costs one row per map task. A group's row that stays is the smallest id, or the
largest on demand.

Nulls: a null text counts as empty, a null id never stays while its group has
another. Rows repeating both id and text are one document to ``classes`` (all of
them carry ``kept``); ``keep_rows`` returns one of them. An empty table gives an
empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import text_of


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def classes(
    docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda t: t, hash: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Per row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of the normalised text.

    The class is formed on the bytes; a row then finds its class by the hash and
    the SHA-256 of its text, so texts are shuffled once and only where they differ.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id).alias("_id"), normalise(text_of(text)).alias("_text")).withColumn("_hash", hash(F.col("_text")))
    digest = F.sha2(F.col("_text"), 256)
    groups = (
        rows.groupBy("_hash", "_text").agg(pick("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_hash", digest.alias("text_sha256"), "keep_id", "group_size")
    )
    return (
        rows.select("_id", "_hash", digest.alias("text_sha256")).join(groups, ["_hash", "text_sha256"])
        .select(F.col("_id").alias(id), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def keep_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, whole: one per distinct text, in one shuffle."""
    rest = [c for c in docs.columns if c != text]
    order = [id, *[c for c in rest if c != id]]
    # The first field puts null ids last either way.
    lead = F.col(id).isNull() if keep == "smallest" else F.col(id).isNotNull()
    row = F.struct(lead.alias("_lead"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(order)], F.col(text).isNull().alias("_blank"))
    pick = {"smallest": F.min, "largest": F.max}[keep]
    groups = docs.groupBy(content_hash(text_of(text)).alias("_hash"), text_of(text).alias("_text")).agg(pick(row).alias("_row"))
    back = {c: F.col(f"_row.c{i}") for i, c in enumerate(order)}
    back[text] = F.when(~F.col("_row._blank"), F.col("_text"))
    return groups.select(*[back[c].alias(c) for c in docs.columns])
