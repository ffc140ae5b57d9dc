"""Chunk windows, embedding, content hashes and the incremental index."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as ty

from chatloom.functions import text as T
from chatloom.plans.blocks import running_total

SIZE, OVERLAP = 1200, 200
SCHEMA_TAG = "chunk-index/1"
Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def records(heads: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Index input: titled, dated, non-blank transcripts."""
    empty = F.lit("")
    return (
        heads.join(texts.where(T.has_text(F.col("text"))), key)
        .withColumn("title", F.coalesce(F.nullif("title", empty), F.lit("(untitled)")))
        .withColumn("update_date", F.coalesce(F.nullif("update_date", empty), F.nullif("create_date", empty), empty))
        .select(key, "title", "update_date", "text")
    )


def n_windows(length: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    step = size - overlap
    return F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / F.lit(step)).cast("int") + 1)


def windows(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping character windows over the whole text; blank windows are left out.

    Adds ``start``, ``end`` (exclusive) and replaces ``text`` by the window.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    step = size - overlap
    whole, part = divmod(size, step)
    rest = [c for c in df.columns if c != text]
    # The text is cut into steps in one pass; a window is ``whole`` steps and the
    # head of the next one. Taking substrings of the whole text instead would walk
    # it from the start for every window.
    steps = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def window(i):
        head = F.substring(F.coalesce(F.get("_steps", i + whole), F.lit("")), 1, part) if part else F.lit("")
        body = F.concat(F.array_join(F.slice("_steps", i + 1, F.lit(whole)), ""), head)
        return F.struct((i * step).cast("bigint").alias("start"), body.alias("chunk"))

    numbers = F.sequence(F.lit(0), n_windows(F.col("_n"), size, overlap) - 1)
    return (
        df.where(T.has_text(F.col(text)))
        .select(*rest, F.length(text).alias("_n"), steps.alias("_steps"))
        .select(*rest, F.explode(F.transform(numbers, window)).alias("w"))
        .select(
            *rest,
            "w.start",
            (F.col("w.start") + F.length("w.chunk")).cast("bigint").alias("end"),
            F.col("w.chunk").alias(text),
        )
        .where(T.has_text(F.col(text)))
    )


def embed_input(title: Column, date: Column, chunk: Column, titled: bool = True) -> Column:
    return F.concat(title, F.lit(" ("), date, F.lit(")\n"), chunk) if titled else chunk


def hashed_words(dim: int = 64) -> Embed:
    """Stand-in for a model where ``embed`` wants a function: dense vectors of ``hashed_counts``."""
    import hashlib
    import re

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype="float32")
        seen: dict[str, int] = {}
        for i, text in enumerate(texts):
            for word in re.findall("[a-z0-9]+", text.lower()):
                if word not in seen:
                    seen[word] = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim
                out[i, seen[word]] += 1.0
        return out

    return embed


def hashed_counts(df: DataFrame, text: str, keys: Sequence[str], dim: int = 64) -> DataFrame:
    """Hashed bag of words as sparse vectors: one row (keys, ``i``, ``n``) per dimension that is not zero.

    The same numbers as ``hashed_words``, made by column functions and one aggregate.
    """
    words = df.select(*keys, F.explode(T.words(F.col(text))).alias("word"))
    i = F.conv(F.substring(F.md5("word"), 1, 7), 16, 10).cast("bigint") % dim
    return words.groupBy(*keys, i.alias("i")).agg(F.count(F.lit(1)).alias("n"))


def embed(df: DataFrame, text: str, fn: Embed, batch: int = 16, out: str = "vec") -> DataFrame:
    """Add the vectors of a user-supplied ``fn(texts)``, called on small batches in row order."""
    schema = ty.StructType([*df.schema.fields, ty.StructField(out, ty.ArrayType(ty.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, vectors = frame[text].tolist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                got = fn(part)
                if len(got) != len(part):
                    raise ValueError(f"embedder returned {len(got)} vectors for {len(part)} texts")
                vectors.extend(np.asarray(v, dtype="float32") for v in got)
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def content_hash(title: Column, date: Column, text: Column) -> Column:
    blank = [F.coalesce(c.cast("string"), F.lit("")) for c in (title, date, text)]
    return F.sha1(F.concat_ws("\0", *blank))


def reuse_plan(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Which chats keep their vectors: same content hash and same number of chunks."""
    old = before.select(key, F.col("hash").alias("old_hash"), F.col("n_chunks").alias("old_n"))
    same = (F.col("hash") == F.col("old_hash")) & (F.col("n_chunks") == F.col("old_n"))
    return now.join(old, key, "left").select(
        *now.columns, F.coalesce(same, F.lit(False)).alias("reused")
    )


def refresh(now_chunks: DataFrame, old_index: DataFrame, key: str, fn: Embed, batch: int = 16) -> DataFrame:
    """Current chunks with vectors; only chats that changed are embedded.

    ``now_chunks``: key, title, update_date, start, end, text, hash, n_chunks.
    ``old_index``: key, start, vec, hash, n_chunks.
    """
    chats = now_chunks.select(key, "hash", "n_chunks").distinct()
    old_chats = old_index.select(key, "hash", "n_chunks").distinct()
    plan = reuse_plan(chats, old_chats, key)
    kept = now_chunks.join(plan.where("reused").select(key), key, "left_semi").join(
        old_index.select(key, "start", "vec"), [key, "start"]
    )
    changed = now_chunks.join(plan.where("NOT reused").select(key), key, "left_semi").withColumn(
        "_in", embed_input(F.col("title"), F.col("update_date"), F.col("text"))
    )
    fresh = embed(changed, "_in", fn, batch).drop("_in")
    return kept.select(fresh.columns).unionByName(fresh)


def row_offsets(counts: DataFrame, key: str) -> DataFrame:
    """Dense ``row_start``/``row_end`` of each chat in key order, from chunk counts. Keys may be of any type."""
    rows = running_total(counts.select(key, "n_chunks"), [key], F.col("n_chunks"), "row_start")
    return rows.select(key, "n_chunks", "row_start", (F.col("row_start") + F.col("n_chunks")).alias("row_end"))


def index_delta(catalog: DataFrame, indexed: DataFrame, key: str, max_refresh: int = 200) -> DataFrame:
    """Chats the index has not captured, counted both ways, and whether to refresh inline."""
    both = (
        catalog.select(key, F.lit(1).alias("c"), F.lit(0).alias("i"))
        .unionByName(indexed.select(key, F.lit(0).alias("c"), F.lit(1).alias("i")))
        .groupBy(key)
        .agg(F.max("c").alias("c"), F.max("i").alias("i"))
    )
    sizes = both.agg(
        F.count_if(F.col("c") == 1).alias("n_catalog"),
        F.count_if(F.col("i") == 1).alias("n_indexed"),
        F.count_if((F.col("c") == 1) & (F.col("i") == 0)).alias("n_missing"),
    )
    delta = F.greatest(F.lit(0), F.col("n_catalog") - F.col("n_indexed"))
    return sizes.select(
        "n_catalog",
        "n_indexed",
        "n_missing",
        delta.alias("delta"),
        ((delta > 0) & (delta <= max_refresh)).cast("bigint").alias("auto_refresh"),
    )


def resume(bundles: DataFrame, done: DataFrame, key: str = "slug") -> DataFrame:
    """Bundles still to do: those without a finished item of the same content."""
    return bundles.join(done.select(key, "bundle_sha").distinct(), [key, "bundle_sha"], "left_anti")
