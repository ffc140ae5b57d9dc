"""Line deduplication over range-partitioned line hashes.

Every line long enough gives a row (128-bit hash of its key, document, position),
no text. Rows are range-partitioned by (hash, document) and sorted with the
largest document first, so a very common line spreads over many parts. A part is
streamed once: the first document of a run of equal hashes keeps its lines, the
rows of further documents are held back until the line has been seen in enough
documents and are then let through as drops. Runs that reach the edge of a part
are first counted over all parts: two rows per part. Drops come back as one compressed
bitmap per document and meet the texts only there.

Defined results: a null or empty text is one empty line; a null id is a document of
its own, smaller than any other; rows that share an id are one document whose lines
are counted together and are told apart by a hash of their texts (equal rows get
equal results); an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import BLANKS, arrow_batches, shuffle_parts, text_of
from chatloom.session import cut

ROWS = "h1 bigint, h2 bigint, doc bigint, copy bigint, pos int"


def line_key(line: str) -> str:
    """The line without blanks at its ends and with A-Z in lower case."""
    line = line.strip(BLANKS)
    return line.lower() if line.isascii() else line.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def line_rows(docs: DataFrame, min_chars: int, id: str, text: str) -> DataFrame:
    """(hash, document, position) of every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs_, copies, places = [], [], [], []
            for doc, copy, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for pos, line in enumerate(value.split("\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(key.encode()))
                        docs_.append(doc)
                        copies.append(copy)
                        places.append(pos)
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(docs_, pa.int64()),
                 pa.array(copies, pa.int64()), pa.array(places, pa.int32())],
                ["h1", "h2", "doc", "copy", "pos"])

    return docs.select(F.col(id).cast("long"), F.xxhash64(text).alias("_copy"), text_of(text).alias("_text")).mapInArrow(run, ROWS)


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of each batch with rows; null documents as the smallest integer."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(i).fill_null(np.iinfo(np.int64).min).to_numpy() if i == 2 else batch.column(i).to_numpy() for i in range(n)]


def edges(rows: DataFrame) -> DataFrame:
    """Documents and largest document of the first and last run of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # [h1, h2, documents, largest document, last document seen]
        for h1, h2, doc in _runs(batches, 3):
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            starts = np.append(np.nonzero(new)[0], len(h1))
            steps = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
            for k in sorted({0, len(starts) - 2}):
                a, b = starts[k], starts[k + 1]
                now = [int(h1[a]), int(h2[a]), int(steps[b - 1] - steps[a] + 1), int(doc[a]), int(doc[b - 1])]
                if last and last[:2] == now[:2]:
                    last[2] += now[2] - (last[4] == int(doc[a]))
                    last[4] = now[4]
                else:
                    if last and first is None:
                        first = last
                    last = now
        out = [x for x in (first, last) if x]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["h1", "h2", "n", "top"])

    return rows.select("h1", "h2", "doc").mapInArrow(run, "h1 bigint, h2 bigint, n bigint, top bigint")


def drops(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, copy, pos) of every line that goes."""
    arrow_batches(docs.sparkSession)
    key = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last()]
    # A checkpoint keeps parts and their order, which both passes below rely on.
    held = cut(
        line_rows(docs, min_chars, id, text)
        .repartitionByRange(shuffle_parts(docs), *key).sortWithinPartitions(*key, "copy", "pos"))
    # Two rows per part at most, so the driver's table is bounded by the number of parts.
    cross = edges(held).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    known = {(r["h1"], r["h2"]): (r["n"] >= min_docs, r["top"]) for r in cross}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None  # an open run that is not yet in enough documents
        common: tuple[tuple[int, int], int] | None = None  # an open run that is
        for cols in _runs(batches, 5):
            if carry:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
                carry = None
            h1, h2, doc, copy, pos = cols
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], len(h1))
            steps = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
            often = steps[ends - 1] - steps[starts] + 1 >= min_docs
            top = doc[starts].copy()
            last = len(starts) - 1
            for k in sorted({0, last}):
                run_key = (int(h1[starts[k]]), int(h2[starts[k]]))
                if run_key in known:
                    often[k], top[k] = known[run_key]
                elif common and common[0] == run_key:
                    often[k], top[k] = True, common[1]
                elif k == last and not often[k]:
                    carry = [x[starts[k]:] for x in cols]
                if k == last:
                    common = (run_key, int(top[k])) if often[k] else None
            of_run = np.cumsum(new) - 1
            goes = often[of_run] & (doc != top[of_run])
            if goes.any():
                none = doc[goes] == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[goes], pa.int64(), mask=none), pa.array(copy[goes]), pa.array(pos[goes], pa.int32())], ["doc", "copy", "pos"])

    return held.mapInArrow(run, "doc bigint, copy bigint, pos int")


def bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document that loses lines: (doc, copy, n_dropped, keep).

    ``keep`` is a compressed bitmap of its lines, 1 for a line that stays; lines
    beyond its end stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for gone in batch.column(2).to_pylist():
                bits = np.ones((max(gone) // 8 + 1) * 8, np.uint8)
                bits[gone] = 0
                packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(g) for g in batch.column(2).to_pylist()], pa.int64()), pa.array(packed, pa.binary())],
                ["doc", "copy", "n_dropped", "keep"])

    # Equal rows of one id give the same positions: a set, as large as a text's lines at most.
    gone = drops(docs, min_chars, min_docs, id, text).groupBy("doc", "copy").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(run, "doc bigint, copy bigint, n_dropped bigint, keep binary")


def apply(docs: DataFrame, maps: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``n_lines`` before dropping, ``n_dropped`` and the text that is ``kept``."""
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.xxhash64(text).alias("_copy"), text_of(text).alias("_text"))
    met = rows.join(maps, rows["_id"].eqNullSafe(maps["doc"]) & (rows["_copy"] == maps["copy"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, kept = [], []
            for value, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if keep is None:
                    n_lines.append(value.count("\n") + 1)
                    kept.append(value)
                else:
                    lines = value.split("\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little").tolist()
                    n_lines.append(len(lines))
                    bits = bits[: len(lines)]
                    kept.append("\n".join([x for x, b in zip(lines, bits) if b] + lines[len(bits):]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), batch.column(3), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    out = met.select("_id", "_text", "keep", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    return out.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string").withColumnRenamed("doc_id", id)
