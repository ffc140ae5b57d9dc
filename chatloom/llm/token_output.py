"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on the document id.

Documents are range-partitioned by id before they are encoded, so each task
encodes and writes one run of ids in ascending order and nothing is shuffled
twice. A row holds its part, the ids before it in the part, its ids and their
number. Offsets over the whole output need only the parts' totals, which come from
two small columns. Stripes are read in parallel; a look-up by id is answered from
file and stripe statistics, row indexes and Bloom filters.

Defined results: a null or empty text has the end id alone; a null id sorts first;
rows that share an id follow each other by text; an empty table gives an empty file
set. The tokenizer file is read at its path on every node.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chatloom.llm.common import Memo, arrow_batches, shuffle_parts, text_of, worker_cache

#: Bytes of pieces and their ids that a Python worker remembers; longer pieces are asked every time.
MEMO_BYTES, LONG = 256 << 20, 256
#: Characters of texts worked on together, bytes looked at in one step, pieces in one string for the library.
BLOCK_CHARS, SLICE, TOGETHER = 1 << 22, 1 << 20, 2048

#: Kinds of bytes: letters, digits, signs and blanks as the pretokenizer's pattern has them, characters
#: that are no blank but else unknown, characters that may be a blank, and what stands behind each text.
OTHER, MAYBE, LETTER, DIGIT, SIGN, QUOTE, SPACE, BLANK, END = range(9)
VISIBLE = {OTHER, LETTER, DIGIT, SIGN, QUOTE}
#: What stands behind each text: no byte of UTF-8.
STOP = b"\xff"


def _kinds() -> bytes:
    """Kind of each byte on its own."""
    kinds = bytearray([OTHER] * 256)
    for c in map(chr, range(128)):
        if c.isalpha():
            kinds[ord(c)] = LETTER
        elif c.isdigit():
            kinds[ord(c)] = DIGIT
        elif c.isspace():
            kinds[ord(c)] = SPACE if c == " " else BLANK if c in "\t\n\v\f\r" else MAYBE
        elif c.isprintable():
            kinds[ord(c)] = QUOTE if c == "'" else SIGN
    kinds[STOP[0]] = END
    return bytes(kinds)


def _kinds_of_two() -> np.ndarray:
    """Kind of a character by its first two bytes."""
    kinds = np.full(1 << 16, OTHER, np.uint8)
    for c in map(chr, range(0x80, 0x800)):
        kinds[int.from_bytes(c.encode())] = LETTER if c.isalpha() else OTHER
    for c in "\x85\xa0\u1680\u2000\u2040\u3000":
        kinds[int.from_bytes(c.encode()[:2])] = MAYBE
    return kinds


def _cuts() -> bytes:
    """By the kinds of neighbours: 1 where a piece ends between them, 2 where one ends before the first of them."""
    cuts = bytearray(256)
    for a in range(9):
        for b in range(9):
            blank = b in (SPACE, BLANK)
            ends = END in (a, b) or (a in VISIBLE and blank) or (a == BLANK and b in VISIBLE)
            # A quote and what follows it may be one piece, as in "it's".
            ends |= (a in (LETTER, DIGIT, SIGN) or (a, b) == (QUOTE, DIGIT)) and b in (LETTER, DIGIT, SIGN, QUOTE) and a != b and {a, b} != {SIGN, QUOTE}
            cuts[a << 4 | b] = ends | 2 * (a in (SPACE, BLANK) and b in VISIBLE)
    return bytes(cuts)


class Encoder:
    """A byte-level tokenizer of the library that is asked once for each new piece of text.

    Its pattern begins a new match where visible characters of different kinds meet, at
    blanks behind them, at the last of some blanks before them and, if that is no space,
    behind it. Texts are cut at such places only, wherever the bytes around tell for sure;
    pieces may hold several matches. New pieces go to the library many in one string whose
    tokens tell where each begins. Texts with added tokens, and all texts of a tokenizer
    with another pattern, go to the library whole.
    """

    def __init__(self, path: str):
        # A worker is one thread of an executor: the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        form = json.loads(self.library.to_str())
        split = form["pre_tokenizer"] or {}
        self.known = form["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        vocab = self.library.get_vocab(True)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced, self.line = np.zeros((2, 1 + max(vocab.values())), bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.line[[i for t, i in vocab.items() if t == "Ċ"]] = True
        self.kind = "<u2" if len(self.line) <= 1 << 16 else "<u4"
        self.kinds, self.kinds_of_two, self.cuts = _kinds(), _kinds_of_two(), _cuts()
        # A visible character, perhaps behind a space, and no blank after it.
        self.simple = re.compile(rb"( ?)[!-~\xc3-\xe0\xe4-\xf4][^\x00-\x20]*")
        self.pieces = Memo(MEMO_BYTES)

    @classmethod
    def of_worker(cls, path: str) -> "Encoder":
        """The encoder of this Python worker: its memo serves all tasks that the worker runs."""
        held = worker_cache()
        if ("token_output", path) not in held:
            held["token_output", path] = cls(path)
        return held["token_output", path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _together(self, pieces: list[bytes], before: bytes, opens: np.ndarray) -> list[bytes]:
        """Ids of pieces that, behind the one token ``before`` or nothing, begin with a token that ``opens``."""
        width = int(self.kind[-1])
        skip = len(before) * width
        out: list[bytes] = []
        for k in range(0, len(pieces), TOGETHER):
            part = pieces[k : k + TOGETHER]
            text = (before + before.join(part)).decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            cuts = (np.nonzero(opens[ids])[0] * width).tolist()
            if len(cuts) == len(part) and not any(s in text for s in self.added):
                raw = ids.tobytes()
                out += [raw[a + skip : b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
            else:  # some token opens inside a piece: ask one by one
                out += self._whole([p.decode() for p in part])
        return out

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces: those behind a space side by side, those without one on lines, others one by one."""
        kinds: dict[bytes | None, list[int]] = {b" ": [], b"": [], None: []}
        for k, piece in enumerate(pieces):
            form = self.simple.fullmatch(piece)
            kinds[form and form[1]].append(k)
        out = [b""] * len(pieces)
        for form, ask in (
            (b" ", lambda some: self._together(some, b"", self.spaced)),
            (b"", lambda some: self._together(some, b"\n", self.line)),
            (None, lambda some: self._whole([p.decode() for p in some])),
        ):
            for k, ids in zip(kinds[form], ask([pieces[k] for k in kinds[form]])):
                out[k] = ids
        return out

    def _ends(self, raw: bytes) -> np.ndarray:
        """Where the pieces of some texts end, each text with ``STOP`` behind it."""
        kinds = np.frombuffer(bytearray(raw.translate(self.kinds)), np.uint8)
        codes = np.frombuffer(raw, np.uint8)
        for at in range(0, len(raw), SLICE):
            part = codes[at : at + SLICE]
            wide = np.flatnonzero((part >= 0x80) & (part < STOP[0])) + at
            first = codes[wide] >= 0xC0
            lead, follow = wide[first], wide[~first]
            kinds[lead] = self.kinds_of_two[codes[lead].astype(np.uint16) << 8 | codes[lead + 1]]
            for _ in range(3):  # the other bytes of a character are of its kind
                kinds[follow] = kinds[follow - 1]
        cuts = np.frombuffer((kinds[:-1] << 4 | kinds[1:]).tobytes().translate(self.cuts), np.uint8)
        inside = cuts & 1
        inside[:-1] |= cuts[1:] >> 1
        return np.append(np.flatnonzero(inside) + 1, len(raw))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        whole = [not self.known or any(s in text for s in self.added) for text in texts]
        raw = b"".join((b"" if w else text.encode()) + STOP for text, w in zip(texts, whole))
        ends = np.concatenate(([0], self._ends(raw)))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        some, row = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        get = self.pieces.learn((p for p in some if len(p) <= LONG and p != STOP), self._learn)
        alone = iter(self._whole([p.decode() for p in some if len(p) > LONG]))
        ids = [b"" if p == STOP else get(p) if len(p) <= LONG else next(alone) for p in some]
        # The ids of the pieces in the order of the texts.
        cuts = np.concatenate(([0], np.cumsum([len(b) for b in ids]) // int(self.kind[-1])))
        lists = pa.LargeListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(ids), self.kind))).take(pa.array(row))
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        stops = starts[np.flatnonzero(row == some.index(STOP))].tolist()
        other = iter(self._whole([text for text, w in zip(texts, whole) if w]))
        return [np.frombuffer(next(other), self.kind) if w else flat[a:b] for w, a, b in zip(whole, [0, *stops], stops)]


def write(docs: DataFrame, out: str, path: str, end_id: int = 0, id: str = "doc_id", text: str = "text", stripe_mb: int = 16, stride: int = 1000) -> None:
    """Encode all texts and write ``out``: ORC files in ascending order of id."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id).alias("doc_id"), text_of(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = (
        rows.repartitionByRange(shuffle_parts(docs), "doc_id").sortWithinPartitions("doc_id", "_text")
        .select("doc_id", "_text", F.spark_partition_id().alias("part"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = Encoder.of_worker(path), 0
        end = np.array([end_id], np.int32)
        for batch in batches:
            texts, first = batch.column(1).to_pylist(), 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and size < BLOCK_CHARS:
                    size += len(texts[last])
                    last += 1
                ids = encoder.encode(texts[first:last])
                counts = np.array([len(x) + 1 for x in ids], np.int64)
                ends = np.cumsum(counts)
                flat = np.concatenate([y for x in ids for y in (x, end)], dtype=np.int32, casting="unsafe")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first),
                     pa.array(before + ends - counts), pa.array(counts), lists],
                    ["doc_id", "part", "before", "n_tokens", "ids"])
                before += int(ends[-1])
                first = last

    tokens = ordered.mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids array<int>")
    (
        tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", stride).option("orc.stripe.size", stripe_mb << 20).option("compression", "zstd").orc(out)
    )


def read(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``."""
    rows = spark.read.orc(out)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per written part, whatever the number of documents.
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("_base") + F.col("before")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, out: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter prunes files, stripes and row groups."""
    return spark.read.orc(out).where(F.col("doc_id").isin(ids))


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    import zlib

    names = [c for c in rows.columns if c != "ids"]
    arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            cuts = (lists.offsets.to_numpy()).tolist()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    kept = rows.select(*names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.select(*names, "ids").mapInArrow(run, f"{columns}, ids_crc32 bigint")
