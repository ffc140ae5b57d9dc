"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text starts as one symbol per byte. The leaves of a segment tree hold
the merge rank of each adjacent pair, every inner node the smaller of its
children, so the root is the lowest rank and the way down that prefers left is its
leftmost place. A merge changes three leaves, each repaired in logarithmic steps,
until the root says that no pair can merge. Trees of many pieces of one width are
rows of one matrix and are worked on together; a piece of any length has a tree as
wide as it needs.

The vocabulary is a tokenizer file whose path is a parameter; it must be readable
at that path on every node. Supported are BPE files with byte-level symbols, with
or without an end-of-word suffix, as described by the file itself.

Defined results: null and empty texts give no ids and decode to the empty text;
special tokens written out in a text become their ids, as the file says; rows
repeat as given; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import Memo, arrow_batches, text_of, worker_cache

NONE = np.int32(2**31 - 1)
#: The split that byte-level files with ``use_regex`` imply; fixed by the file format.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of this many characters are collected before their trees are built.
BLOCK_CHARS = 1 << 21
#: Bytes of chunks and their ids that a worker remembers.
MEMO_BYTES = 192 << 20
#: Symbols from which a tree is worked on by itself, all places of one rank at a time.
WIDE = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or 256 and up in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(spare))
        spare += b not in printable
    return out


class PairTrees:
    """Segment trees over the adjacent pairs of many symbol rows of one width."""

    def __init__(self, ranks: "Merges", symbols: np.ndarray, lengths: np.ndarray):
        n, width = symbols.shape
        self.ranks, self.width, self.symbols = ranks, width, symbols
        place = np.arange(width, dtype=np.int32)
        # Neighbours in the row; ``width`` and -1 stand for none.
        self.after = np.where(place + 1 < lengths[:, None], place + 1, width).astype(np.int32)
        self.before = np.broadcast_to(place - 1, (n, width)).astype(np.int32)
        self.tree = np.full((n, 2 * width), NONE, np.int32)
        rows, left = np.nonzero(place[None, :] + 1 < lengths[:, None])
        self.tree[rows, width + left] = ranks.of(symbols[rows, left], symbols[rows, left + 1])
        level = width
        while level > 1:
            pairs = self.tree[:, level : 2 * level]
            level //= 2
            self.tree[:, level : 2 * level] = np.minimum(pairs[:, 0::2], pairs[:, 1::2])

    def merge_all(self) -> None:
        if self.width >= WIDE:
            for row in range(len(self.tree)):
                while self.tree[row, 1] != NONE:
                    self._merge_equal(row)
            return
        rows = np.nonzero(self.tree[:, 1] != NONE)[0]
        while rows.size:
            self._merge(rows)
            rows = rows[self.tree[rows, 1] != NONE]

    def _merge(self, rows: np.ndarray) -> None:
        """Merge the leftmost lowest-rank pair of each row and repair its tree."""
        tree, width = self.tree, self.width
        rank = tree[rows, 1]
        node = np.ones(rows.size, np.int64)
        for _ in range(width.bit_length() - 1):
            node *= 2
            node += tree[rows, node] != rank
        at = node - width
        gone = self.after[rows, at]
        beyond = self.after[rows, gone]
        self.symbols[rows, at] = self.ranks.merged[rank]
        self.symbols[rows, gone] = -1
        self.after[rows, at] = beyond
        has = beyond < width
        self.before[rows[has], beyond[has]] = at[has]
        tree[rows, width + gone] = NONE
        tree[rows, width + at] = NONE
        r, a = rows[has], at[has]
        tree[r, width + a] = self.ranks.of(self.symbols[r, a], self.symbols[r, beyond[has]])
        prior = self.before[rows, at]
        led = prior >= 0
        r, p = rows[led], prior[led]
        tree[r, width + p] = self.ranks.of(self.symbols[r, p], self.symbols[r, at[led]])
        who = np.concatenate((rows, rows, r))
        where = np.concatenate((width + at, width + gone, width + p))
        while where.size and where[0] > 1:
            where = where >> 1
            tree[who, where] = np.minimum(tree[who, 2 * where], tree[who, 2 * where + 1])


    def _merge_equal(self, row: int) -> None:
        """Merge a wide row's places of the lowest rank from the left, up to the first that makes a pair of lower rank.

        Places that overlap are taken by turns, as merging them one by one from the left does.
        """
        tree, width = self.tree[row], self.width
        after, before, symbols = self.after[row], self.before[row], self.symbols[row]
        rank = int(tree[1])
        nodes = np.ones(1, np.int64)
        while nodes[0] < width:
            nodes = np.repeat(2 * nodes, 2)
            nodes[1::2] += 1
            nodes = nodes[tree[nodes] == rank]
        places = nodes - width
        begins = np.concatenate(([True], after[places[:-1]] != places[1:]))
        index = np.arange(len(places))
        at = places[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
        gone = after[at]
        beyond, prior = after[gone], before[at]
        merged = np.int32(self.ranks.merged[rank])
        right = np.where(beyond < width, symbols[np.minimum(beyond, width - 1)], -1)
        left = np.where(prior >= 0, symbols[prior], -1)
        whole = np.full(len(at), merged, np.int32)
        upset = np.minimum(self.ranks.of(left, whole), self.ranks.of(whole, right)) < rank
        if self.ranks.of(whole[:1], whole[:1])[0] < rank:
            upset[:] = True
        if upset.any():
            stop = int(np.argmax(upset)) + 1
            at, gone, beyond, prior = at[:stop], gone[:stop], beyond[:stop], prior[:stop]
        symbols[at], symbols[gone] = merged, -1
        after[at] = beyond
        has = beyond < width
        before[beyond[has]] = at[has]
        tree[width + gone] = NONE
        # Neighbours may have merged as well: the one before a place is looked up again.
        prior = before[at]
        starts = np.unique(np.concatenate((at, prior[prior >= 0])))
        ends = after[starts]
        pairs = self.ranks.of(symbols[starts], np.where(ends < width, symbols[np.minimum(ends, width - 1)], -1))
        tree[width + starts] = np.where(ends < width, pairs, NONE)
        where = np.unique(np.concatenate((width + gone, width + starts)))
        while where[0] > 1:
            where = np.unique(where >> 1)
            tree[where] = np.minimum(tree[2 * where], tree[2 * where + 1])


class Merges:
    """Ranks and results of the merges, looked up for arrays of pairs."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        keys = np.array([(a << 32) | b for a, b in pairs] or [0], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.merged = np.array(merged or [0], np.int32)
        if not pairs:
            self.keys = np.array([-1], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        signs = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in signs], np.int32)
        self.last = np.array([vocab.get(s + suffix, -1) for s in signs], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        steps = {x["type"] for x in _flat(spec["normalizer"], "normalizers")}
        self.nfc, self.lower = "NFC" in steps, "Lowercase" in steps
        split = next((x["pattern"]["Regex"] for x in _flat(spec["pre_tokenizer"], "pretokenizers") if x["type"] == "Split"), None)
        #: Files with their own split drop white space; the others keep it in the pieces.
        self.drops_blanks = split is not None
        self.pattern = regex.compile(split or BYTE_PATTERN)
        self.byte_decoder = {s: b for b, s in enumerate(signs)}
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.memo = Memo(MEMO_BYTES)

    @classmethod
    def of_worker(cls, path: str) -> "Bpe":
        held = worker_cache()
        if ("bpe", path) not in held:
            held["bpe", path] = cls(path)
        return held["bpe", path]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        widths: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            widths.setdefault(max(2, 1 << (len(b) - 1).bit_length()) if b else 0, []).append(i)
        for width, members in widths.items():
            # A matrix of at most a million symbols at a time, one row at least.
            step = max(1, (1 << 20) // max(1, width))
            for k in range(0, len(members) if width else 0, step):
                part = members[k : k + step]
                lengths = np.array([len(raw[i]) for i in part], np.int32)
                flat = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
                inside = np.arange(width, dtype=np.int32)[None, :] < lengths[:, None]
                symbols = np.full((len(part), width), -1, np.int32)
                symbols[inside] = self.inner[flat]
                ends = np.cumsum(lengths) - 1
                symbols[np.arange(len(part)), lengths - 1] = self.last[flat[ends]]
                PairTrees(self.merges, symbols, lengths).merge_all()
                live = symbols >= 0
                ids = symbols[live].astype("<u4")
                cuts = np.concatenate(([0], np.cumsum(live.sum(axis=1)))).tolist()
                for j, i in enumerate(part):
                    out[i] = ids[cuts[j] : cuts[j + 1]].tobytes()
        return out

    def _normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # One character at a time where the context would matter (final sigma).
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text

    def _chunks(self, text: str) -> list[str]:
        """Parts of a normalised text that are split into pieces on their own."""
        if not self.drops_blanks:
            return self.pattern.findall(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks to str.split, not to the pattern
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, each distinct piece encoded once."""
        pieces = [self.pattern.findall(c) if self.drops_blanks else [c] for c in chunks]
        unseen = list({p for ps in pieces for p in ps})
        ids = dict(zip(unseen, self.encode_pieces(unseen)))
        return [b"".join(map(ids.__getitem__, ps)) for ps in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts: list[list[str | int]] = []
        new: set[str] = set()
        for text in texts:
            segments = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
            mine: list = []
            for k, segment in enumerate(segments):
                if k % 2:
                    mine.append(self.special[segment])
                elif segment:
                    chunks = self._chunks(self._normal(segment))
                    mine.append(chunks)
                    new.update(chunks)
            parts.append(mine)
        get = self.memo.learn(new, self._learn)
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in mine]) for mine in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids as the file's decoder gives it: bytes put back, or tokens joined by a space."""
        tokens = map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if not self.byte_level_decoder:
            return " ".join(tokens)
        return bytes(b for t in tokens for b in ([self.byte_decoder[c] for c in t] if t not in self.special else t.encode())).decode("utf-8", "replace")


def _flat(step: dict | None, inner: str) -> list[dict]:
    return [] if step is None else step.get(inner, [step])


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, one text at least."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens`` and ``ids``, packed as little-endian unsigned 32-bit integers."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of_worker(path)
        for batch in batches:
            first = 0
            for part in blocks(batch.column(1).to_pylist()):
                ids = bpe.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                    [id, "n_tokens", "ids"])
                first += len(part)

    rows = docs.select(F.col(id), text_of(text).alias("_text"))
    return rows.mapInArrow(run, f"`{id}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of the packed ``ids``; the columns stay."""
    arrow_batches(encoded.sparkSession)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of_worker(path)
        at = names.index("ids")
        for batch in batches:
            texts = pa.array([bpe.decode(b) for b in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "decoded"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{columns}, decoded string")
