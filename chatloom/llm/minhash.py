"""Near-duplicate groups: one-permutation hashing, optimal densification, banded buckets, star edges.

A text's set holds the distinct shingles of its words. One hash of each shingle
fills all bins at once: its high bits name the bin, the smallest hash stays. An
empty bin borrows from the first filled bin along a probe order of its own that is
the same for all sets. Bands of bins are bucket keys.

Equal sets are one representative from the start, so copies never meet each other.
In a bucket the document that shares most buckets is the centre, and every other
member is compared with the centre alone: a bucket of n gives n - 1 edges. Edges are
confirmed on the full sets. Where a centre is not similar to many members, these form
stars among themselves, as long as that links a fair part. Two members that are similar to each other but not to a
centre are found by what they do not share with it (see ``across``): exactly, and
without forming the pairs of a bucket.

Defined results: a null or empty text has an empty set and no links; a text with
fewer words than a shingle has one shingle, its whole sequence; rows that share an
id are one document with the union of their sets in no way merged: each row's set is
linked under that id; a null id is linked with nothing; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from chatloom.llm.common import arrow_batches, components, stored, text_of

#: A pair with similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
#: Members that a centre leaves unlinked form stars of their own if there are so many of
#: them, and again if a star has linked one in ``FAIR``. The result does not depend on it.
MANY, FAIR = 64, 16
#: Word hashes remembered in a task; a larger memo is dropped and begun anew.
MEMO = 500_000


class _Hashes(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. ``bytes`` lower-cases A-Z and splits at ASCII blanks only."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, np.uint64(k))
        for j in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(words) - k + 1 + j])
    return np.unique(h)


class OnePermutation:
    """Densified one-permutation signatures with ``bins`` (a power of two) values."""

    def __init__(self, bins: int):
        self.bins = bins
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        rng = np.random.Generator(np.random.PCG64(20260101))
        #: Probe order of each bin: random bins first, then every bin once, so that one is filled.
        self.near = rng.integers(0, bins, (bins, 16))
        self.far = np.concatenate((rng.integers(0, bins, (bins, 4 * bins)), np.argsort(rng.random((bins, bins)), axis=1)), axis=1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Signature of a non-empty sorted set."""
        at = hashes >> self.shift
        first = np.concatenate(([True], at[1:] != at[:-1]))
        sig = np.zeros(self.bins, np.uint64)
        filled = np.zeros(self.bins, bool)
        where = at[first].astype(np.int64)
        sig[where] = hashes[first]
        filled[where] = True
        for probes in (self.near, self.far):
            empty = np.nonzero(~filled)[0] if probes is self.near else left
            if not empty.size:
                break
            hit = filled[probes[empty]]
            found = hit.any(axis=1)
            sig[empty[found]] = sig[probes[empty[found], hit[found].argmax(axis=1)]]
            left = empty[~found]
        return sig


def signatures(docs: DataFrame, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc, ``n_shingles``, ``set_id`` (128 bits of the whole set), ``bands`` (bucket keys)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, oph = _Hashes(), OnePermutation(1 << (bands * rows - 1).bit_length())
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, ids, keys = [], [], []
            for value in batch.column(1).to_pylist():
                full = shingle_set(value, shingle, hashes)
                sizes.append(len(full))
                ids.append(hashlib.blake2b(full.tobytes(), digest_size=16).digest())
                if not len(full):
                    keys.append([])
                    continue
                sig = oph.of(full)[: bands * rows].reshape(bands, rows)
                key = salt.copy()
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
                keys.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc", "n_shingles", "set_id", "bands"])

    rows_ = docs.select(F.col(id).cast("long").alias("doc"), text_of(text).alias("_text"))
    return rows_.mapInArrow(run, "doc bigint, n_shingles bigint, set_id binary, bands array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, id: str, text: str) -> DataFrame:
    """(doc, set) of the wanted documents: their sorted shingle hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingle_set(t, shingle, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc", "set"])

    rows = docs.select(F.col(id).cast("long").alias("doc"), text_of(text).alias("_text"))
    return rows.join(wanted.select("doc"), "doc", "left_semi").mapInArrow(run, "doc bigint, set binary")


def compared(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Add (na, nb, both) to the edges (a, b, ...): set sizes and intersection."""
    names = edges.columns
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for x, y in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(many, few), max(len(many) - 1, 0))
                sizes.append((len(x), len(y), int((many[at] == few).sum()) if len(few) else 0))
            columns = [pa.array([s[i] for s in sizes], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], [*names, "na", "nb", "both"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    return _with_sets(edges, sets).select(*names, "sa", "sb").mapInArrow(run, f"{kept}, na bigint, nb bigint, both bigint")


def _with_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    one = edges.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    return one.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a")


def differences(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``gap``: the shingles that the member ``b`` and the centre ``a`` do not share."""
    names = edges.columns
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = [
                np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).astype(np.int64)
                for x, y in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(gaps, pa.list_(pa.int64()))], [*names, "gap"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    return _with_sets(edges, sets).select(*names, "sa", "sb").mapInArrow(run, f"{columns}, gap array<bigint>")


def across(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar though their centre has not linked them.

    ``groups`` has (a, b, nb, label, linked): members b of centre a. Let D be what a
    member does not share with the centre. If x is not similar to the centre and x
    and y are similar, then x and y share more than p / (100 + p) of y's D: so one of
    the first |D| - floor(|D| p / (100 + p)) elements of y's D, in any order, is in
    x's D. The order is by rareness among the members that are not linked, which
    leaves next to no pairs that only share what is common.
    """
    p = percent
    gaps = stored(differences(groups, sets))
    away = gaps.where(~F.col("linked")).select(
        "a", F.col("b").alias("x"), F.col("nb").alias("nx"), F.col("label").alias("lx"), F.size("gap").alias("dx"), F.explode("gap").alias("e"))
    often = away.groupBy("a", "e").agg(F.count("*").alias("f"))
    rows = gaps.select("a", F.col("b").alias("y"), F.col("nb").alias("ny"), F.col("label").alias("ly"), "linked", F.size("gap").alias("dy"), F.explode("gap").alias("e"))
    others = F.col("f") - F.when(F.col("linked"), 0).otherwise(1)
    met = rows.join(often, ["a", "e"]).withColumn("f", others).where("f > 0")
    listed = met.groupBy("a", "y", "ny", "ly", "dy").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("es"))
    # Elements that no other member has come first and meet nobody.
    first = (F.col("dy") - F.size("es")).alias("first")
    tried = listed.select("a", "y", "ny", "ly", "dy", first, F.posexplode("es").alias("i", "s")).select(
        "a", "y", "ny", "ly", "dy", (F.col("first") + F.col("i")).alias("at"), F.col("s.e").alias("e"))
    tried = tried.where(F.col("at") < F.col("dy") - F.floor(F.col("dy") * p / (100 + p)))
    near = (
        (F.col("x") != F.col("y")) & (F.col("lx") != F.col("ly"))
        & (100 * F.least("nx", "ny") >= p * F.greatest("nx", "ny"))
        & (2 * (100 + p) * (F.col("dy") - F.col("at")) >= (100 + p) * (F.col("dx") + F.col("dy")) - (100 - p) * (F.col("nx") + F.col("ny")))
    )
    met = tried.alias("t").join(away.alias("w"), (F.col("t.a") == F.col("w.a")) & (F.col("t.e") == F.col("w.e")) & near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(docs: DataFrame, sigs: DataFrame, shingle: int, percent: int, id: str, text: str) -> DataFrame:
    """(doc, component) over the confirmed links between representatives of equal sets."""
    reps = sigs.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc").alias("doc"))
    bands = sigs.join(reps, ["set_id", "doc"], "left_semi").select("doc", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = stored(bands.join(shared, "key"))
    score = members.groupBy("doc").agg(F.sum("c").alias("score"))
    scored = stored(members.join(score, "doc").select("key", "doc", "score"))
    top = F.max(F.struct("score", (-F.col("doc")).alias("minus"))).alias("top")
    centres = scored.groupBy("key").agg(top).select("key", (-F.col("top.minus")).alias("a"))
    first = scored.join(centres, "key").where(F.col("doc") != F.col("a")).groupBy("a", F.col("doc").alias("b")).agg(F.first("score").alias("score"))
    sets = stored(full_sets(docs, score, shingle, id, text))

    similar = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    pivots = stored(compared(first, sets).withColumn("linked", similar))
    found = pivots.where("linked").select("a", "b")
    # Where a centre leaves many members unlinked, these form stars among themselves, as
    # long as that links a fair part of them; a few are left to the last step.
    away = pivots.where("NOT linked").select("a", "b", "score")
    many = F.count("*").over(Window.partitionBy("a")) >= MANY
    away = stored(away.withColumn("_many", many).where("_many").drop("_many"))
    while not away.isEmpty():
        best = away.groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("minus"))).alias("top")).select("a", (-F.col("top.minus")).alias("c"))
        around = away.join(best, "a").where(F.col("b") != F.col("c")).select("a", "b", "c", "score")
        tried = stored(compared(around.select(F.col("c").alias("a"), "b", F.col("a").alias("of"), "score"), sets).withColumn("linked", similar))
        found = found.union(tried.where("linked").select("a", "b"))
        hits = F.count_if("linked")
        useful = tried.groupBy("of").agg(hits.alias("hits"), F.count("*").alias("n")).where((F.col("hits") * FAIR >= F.col("n")) & (F.col("n") - F.col("hits") >= MANY))
        away = stored(tried.where("NOT linked").join(useful, "of", "left_semi").select(F.col("of").alias("a"), "b", "score"))
    # What is left goes through the differences to the first centres, without loss.
    labels = stored(components(found))
    name = lambda d, out: labels.select(F.col("doc").alias(d), F.col("component").alias(out))
    grouped = pivots.join(name("a", "la"), "a", "left").join(name("b", "lb"), "b", "left").select(
        "a", "b", "nb", "linked", F.coalesce("lb", "b").alias("label"), F.coalesce("la", "a").alias("own"))
    grouped = stored(grouped)
    split = grouped.groupBy("a").agg(F.min(F.least("label", "own")).alias("lo"), F.max(F.greatest("label", "own")).alias("hi")).where("lo <> hi").select("a")
    rest = grouped.join(split, "a", "left_semi").select("a", "b", "nb", "linked", "label")
    last = stored(compared(across(rest, sets, percent), sets).where(similar).select("a", "b"))
    if last.isEmpty():
        return labels
    # The late links join components: only those ends are labelled anew.
    ends = last.join(name("a", "la"), "a", "left").join(name("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(ends).select(F.col("doc").alias("component"), F.col("component").alias("final"))
    alone = last.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(labels, "doc", "left_anti").select("doc", F.col("doc").alias("component"))
    return labels.union(alone).join(merged, "component", "left").select("doc", F.coalesce("final", "component").alias("component"))


def groups(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links, itself included), ``kept``."""
    sigs = stored(signatures(docs, shingle, bands, rows, id, text))
    known = sigs.where(F.col("doc").isNotNull())
    labels = links(docs, known, shingle, percent, id, text)
    reps = known.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc").alias("rep"))
    named = reps.join(labels.withColumnRenamed("doc", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("_c"))
    # Empty sets are equal too, but linked with nothing.
    out = sigs.join(named, (sigs["set_id"] == named["set_id"]) & sigs["doc"].isNotNull(), "left")
    component = F.coalesce("_c", "doc")
    return out.select(F.col("doc").alias(id), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def keep_rows(docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those near to a document of smaller id, whole."""
    gone = groups(docs, shingle, percent, id, text).where("NOT kept").select(F.col(id).alias("_gone")).distinct()
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")
