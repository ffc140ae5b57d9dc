"""Phrase collocations: frequent phrases from Misra-Gries summaries, counted exactly in a second pass.

First pass: each task counts the n-grams of its own texts and sends one packed row of
counters, told apart by hash, to every hash partition. A partition merges what
arrives into one Misra-Gries summary: above its capacity all counters lose the weight
of the first one too many. The capacity exceeds the partition's mass divided by the
threshold, so all losses together stay below the threshold and every phrase that is
frequent survives (two phrases of one hash share a counter, which only makes it
larger). The survivors of all partitions become a Bloom filter of a fixed number of
bytes. It only spares the shuffle: what passes it is counted by its words.

Second pass: n-grams that pass the filter are counted exactly by (language, phrase);
tasks send them sorted and packed to the same hash partitions.
Phrases at or above the threshold are scored by joins with the counts of their
parts, which are frequent too; phrases inside longer ones nearly as frequent go.

A text of any length is worked on in blocks, cut at a mark between pieces, or at a
blank with the words before it repeated as context. Words get numbers within a block,
and an n-gram is (number of its beginning, number of its last word), so blocks are
exact whatever the words are.

Defined results: a null text is empty; a null language is ``und`` and the same as a
language of that name; repeated rows count each time; languages without a candidate
and empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.llm.common import arrow_batches, stored, text_of

#: What a byte is: part of a word (0), a blank (1) or the end of a piece (2); A-Z are lowered.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE_END = re.compile(rb"[.,;:!?\n-\r]")
BLANK = re.compile(rb"[ \t]")
BLOCK_BYTES = 2 << 20
#: Counters that a task of the first pass holds before it sends them.
HELD = 1 << 20
#: Hash partitions at most.
MOST_PARTS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_words(data: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words of a block, each with the number of its piece."""
    raw = LOWER[np.frombuffer(data, np.uint8)]
    kind = KIND[raw]
    inside = np.zeros(len(raw) + 2, bool)
    np.equal(kind, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:-1]])])
    return words.dictionary_encode(), np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)


def blocks(texts: list[bytes], most: int, limit: int | None = None) -> Iterator[tuple[bytes, int]]:
    """(text, words at its begin that are context only); whole texts are joined by an end of a piece."""
    limit = limit or BLOCK_BYTES
    held: list[bytes] = []
    size = 0
    for text in texts:
        # ``fresh`` is where the block's own bytes begin, after its context.
        at = fresh = context = 0
        while len(text) - fresh > limit:
            found = PIECE_END.search(text, fresh + limit, fresh + 2 * limit) or BLANK.search(text, fresh + limit)
            if not found:
                break
            begun = text[at : found.start()]
            yield begun, context
            at = fresh = found.end()
            context = 0
            if BLANK.match(found.group()):
                # The words before the cut; blanks and marks of any kind part them at least this well.
                tail = begun.rsplit(None, most - 1)
                again = begun[len(tail[0]) :] if len(tail) == most else begun
                context = len(cut_words(again)[0])
                text, at, fresh = again + b" " + text[at:], 0, len(again) + 1
        if at or context:
            yield text[at:], context
            continue
        held.append(text)
        size += len(text)
        if size >= limit:
            yield b"\n".join(held), 0
            held, size = [], 0
    if held:
        yield b"\n".join(held), 0


class Grams:
    """Distinct n-grams of a block, by length: beginnings, last words, counts and hashes."""

    def __init__(self, data: bytes, context: int, most: int, seed: int):
        words, piece = cut_words(data)
        self.dictionary = words.dictionary
        ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(1, len(self.dictionary))
        counted = np.arange(len(ids)) >= context
        self.total = int(counted.sum())
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        own = self._hashes(seed)
        counts = np.bincount(ids[counted], minlength=len(self.dictionary))
        self.levels.append((np.zeros(len(own), np.int64), np.arange(len(own)), counts, own))
        at, code, place = np.arange(len(ids)), ids, np.arange(len(ids))
        for n in range(2, most + 1):
            # ``place`` holds the last word of every n-gram so far, ``code`` its number.
            goes_on = place + 1 < len(ids)
            code, place = code[goes_on], place[goes_on] + 1
            one = piece[place] == piece[place - 1]
            code, place = code[one], place[one]
            distinct, code = np.unique(code * size + ids[place], return_inverse=True)
            first, last = distinct // size, distinct % size
            counts = np.bincount(code[counted[place]], minlength=len(distinct))
            hashes = mixed(self.levels[-1][3][first] * np.uint64(0x9E3779B97F4A7C15) + own[last] + np.uint64(n))
            self.levels.append((first, last, counts, hashes))

    def _hashes(self, seed: int) -> np.ndarray:
        """A polynomial in the bytes of every distinct word."""
        _, offsets, data = self.dictionary.buffers()
        if not len(self.dictionary):
            return np.zeros(0, np.uint64)
        offsets = np.frombuffer(offsets, np.int32)[: len(self.dictionary) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[: offsets[-1]].astype(np.uint64) + np.uint64(1)
        lengths = np.diff(offsets)
        powers = np.full(int(lengths.max()), 0x100000001B3, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        within = np.arange(len(raw)) - np.repeat(offsets[:-1], lengths)
        return mixed(np.add.reduceat(raw * powers[within], offsets[:-1]) + np.uint64(seed))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of all n-grams that occur outside the context."""
        hashes, counts = (np.concatenate([x[k] for x in self.levels]) for k in (3, 2))
        return hashes[counts > 0], counts[counts > 0]

    def texts(self, n: int, chosen: np.ndarray) -> pa.Array:
        """Words of the chosen n-grams of length ``n``, joined by spaces."""
        first, last, *_ = self.levels[n - 1]
        tail = self.dictionary.take(pa.array(last[chosen]))
        if n == 1:
            return tail
        return pc.binary_join_element_wise(self.texts(n - 1, first[chosen]), tail, b" ")


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes with their counts added."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], np.add.reduceat(counts, new) if len(new) else counts


class Summary:
    """A Misra-Gries summary: ``lost`` bounds what any counter has lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((hashes, counts))
        self.waiting += len(hashes)
        if self.waiting > max(1 << 16, self.capacity // 2):
            self.merge()

    def merge(self) -> None:
        parts = [(self.hashes, self.counts), *self.new]
        self.hashes, self.counts = summed(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]))
        self.new, self.waiting = [], 0
        over = len(self.counts) - self.capacity
        if over > 0:
            least = int(np.partition(self.counts, over - 1)[over - 1])
            self.lost += least
            self.counts = self.counts - least
            stays = self.counts > 0
            self.hashes, self.counts = self.hashes[stays], self.counts[stays]

    def frequent(self, threshold: int) -> np.ndarray:
        """Hashes that may have occurred that often; all that have are among them."""
        self.merge()
        return self.hashes[self.counts + self.lost >= threshold]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition, from the upper half of a hash; the lower half tells n-grams of a partition apart."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def bits_of(lower: np.ndarray, part_bytes: int) -> np.ndarray:
    """Two positions of each n-gram within its partition's stretch of the filter."""
    size = np.uint64(8 * part_bytes)
    return np.stack([(mixed(lower + np.uint64(k << 32)) % size).astype(np.int64) for k in (1, 2)])


def pack(lower: np.ndarray, counts: np.ndarray) -> bytes:
    """Counters in ascending order as compressed byte planes of gaps and counts."""
    gaps = np.diff(lower, prepend=np.uint64(0)).astype("<u4")
    planes = [gaps.view(np.uint8).reshape(-1, 4).T, counts.astype("<i8").view(np.uint8).reshape(-1, 8).T]
    return len(lower).to_bytes(8, "little") + pa.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in planes), "zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 12 * n, "zstd", asbytes=True), np.uint8).reshape(12, n)
    gaps, counts = np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), np.ascontiguousarray(planes[4:].T).view("<i8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), counts


def lang_seed(lang: str) -> int:
    import zlib

    raw = lang.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 1)


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a batch by language."""
    groups: dict[str, list[bytes]] = {}
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    for lang, text in zip(batch.column(0).to_pylist(), texts):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def survivors(rows: DataFrame, threshold: int, most: int, parts: int, part_bytes: int) -> DataFrame:
    """(``part``, ``bits``, ``n``): each hash partition's stretch of the filter and its number of survivors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            hashes, counts = np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held])
            part = part_of(hashes, parts)
            order = np.argsort(part, kind="stable")
            hashes, counts, part = hashes[order] & np.uint64(0xFFFFFFFF), counts[order], part[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            mine = [summed(hashes[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cuts[:-1]], pa.int64()), pa.array([int(c.sum()) for _, c in mine], pa.int64()), pa.array([pack(*x) for x in mine], pa.binary())],
                ["part", "mass", "counters"])

        for batch in batches:
            for lang, texts in by_lang(batch):
                for data, context in blocks(texts, most):
                    held.append(Grams(data, context, most, lang_seed(lang)).all())
                    size += len(held[-1][0])
                    if size >= HELD:
                        yield sent()
                        held, size = [], 0
        if size:
            yield sent()

    counters = stored(rows.mapInArrow(count, "part bigint, mass bigint, counters binary"))
    # One row for each partition: what its summary has to bear.
    total = counters.groupBy("part").agg(F.sum("mass").alias("total"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[int, Summary] = {}
        for batch in batches:
            for part, packed, mass in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in summaries:
                    summaries[part] = Summary(mass // threshold + 1)
                summaries[part].add(*unpack(packed))
        for p, summary in summaries.items():
            found = summary.frequent(threshold)
            stretch = np.zeros(8 * part_bytes, bool)
            stretch[bits_of(found, part_bytes).ravel()] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int64()), pa.array([np.packbits(stretch, bitorder="little").tobytes()], pa.binary()), pa.array([len(found)], pa.int64())],
                ["part", "bits", "n"])

    # ``parts`` rows at most, of which there are MOST_PARTS at most.
    dealt = counters.join(F.broadcast(total), "part").select("part", "counters", "total").repartitionById(parts, F.col("part").cast("int"))
    return dealt.mapInArrow(merge, "part bigint, bits binary, n bigint")


def frequent(docs: DataFrame, threshold: int, most: int, lang: str, text: str, part_mass: int, filter_bytes: int) -> DataFrame:
    """(``lang``, ``phrase``, ``words``, ``n``): exact counts at or above the threshold; a null phrase has the words of a language."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    # A word has about six bytes; more n-grams than that only make the summaries larger.
    parts = min(1 + int(size * most // (6 * part_mass)), MOST_PARTS)
    part_bytes = max(8, filter_bytes // parts)
    stretches = bytearray(parts * part_bytes)
    for row in survivors(rows, threshold, most, parts, part_bytes).select("part", "bits").toLocalIterator():
        stretches[row.part * part_bytes : (row.part + 1) * part_bytes] = row.bits
    shared = spark.sparkContext.broadcast(bytes(stretches))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.frombuffer(shared.value, np.uint8)

        def passes(hashes: np.ndarray) -> np.ndarray:
            spots = bits_of(hashes & np.uint64(0xFFFFFFFF), part_bytes) + part_of(hashes, parts) * (8 * part_bytes)
            return ((bloom[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(axis=0)

        held: list[pa.Table] = []
        words: Counter = Counter()
        size = 0
        for batch in batches:
            for name, texts in by_lang(batch):
                for data, context in blocks(texts, most):
                    grams = Grams(data, context, most, lang_seed(name))
                    words[name] += grams.total
                    for n, (_, _, counts, hashes) in enumerate(grams.levels, 1):
                        chosen = np.flatnonzero((counts > 0) & passes(hashes))
                        held.append(pa.table({
                            "lang": pa.DictionaryArray.from_arrays(np.zeros(len(chosen), np.int32), pa.array([name], pa.string())).cast(pa.string()),
                            "part": pa.array(part_of(hashes[chosen], parts), pa.int64()), "phrase": grams.texts(n, chosen), "n": pa.array(counts[chosen], pa.int64())}))
                        size += len(chosen)
                    if size >= HELD:
                        yield from packed_phrases(held)
                        held, size = [], 0
        if size:
            yield from packed_phrases(held)
        if words:
            names = list(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang_seed(x) % parts for x in names], pa.int64()), pa.array(names, pa.string()), pa.array([None] * len(names), pa.binary()),
                 pa.array([words[x].to_bytes(8, "little") for x in names], pa.binary())], PACKED)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        waiting, words = Counter(), Counter()

        def add(lang: str) -> None:
            held[lang] = [pa.concat_tables(held[lang]).group_by("phrase").aggregate([("n", "sum")]).rename_columns(["phrase", "n"])]
            waiting[lang] = 0

        for batch in batches:
            for _, lang, phrases, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if phrases is None:
                    words[lang] += int.from_bytes(counts, "little")
                    continue
                table = unpacked_phrases(phrases, counts)
                held.setdefault(lang, []).append(table)
                waiting[lang] += len(table)
                if waiting[lang] > max(1 << 18, len(held[lang][0])):
                    add(lang)
        for lang in held:
            add(lang)
            found = held[lang][0].filter(pc.field("n") >= threshold)
            for part in found.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), part.column(0).cast(pa.string()), pc.add(pc.count_substring(part.column(0), " "), 1).cast(pa.int32()), part.column(1)], COUNTED)
        if words:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array([None] * len(words), pa.string()), pa.array([0] * len(words), pa.int32()), pa.array(list(words.values()), pa.int64())], COUNTED)

    packed = rows.mapInArrow(count, "part bigint, lang string, phrases binary, counts binary")
    return packed.repartitionById(parts, F.col("part").cast("int")).mapInArrow(tally, "lang string, phrase string, words int, n bigint")


PACKED, COUNTED = ["part", "lang", "phrases", "counts"], ["lang", "phrase", "words", "n"]


def packed_phrases(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """One row for each language and hash partition: its phrases in order, and their counts, both compressed."""
    total = pa.concat_tables(tables).group_by(["lang", "part", "phrase"]).aggregate([("n", "sum")])
    total = total.sort_by([("lang", "ascending"), ("part", "ascending"), ("phrase", "ascending")]).combine_chunks()
    part, lang = total["part"].to_numpy(), total["lang"].combine_chunks().dictionary_encode()
    codes = lang.indices.to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (codes[1:] != codes[:-1]), [True])))
    rows: list[tuple] = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        text = b"\n".join(total["phrase"].slice(a, b - a).to_pylist())
        counts = np.ascontiguousarray(total["n_sum"].slice(a, b - a).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
        rows.append((int(part[a]), lang.dictionary[int(codes[a])].as_py(), *(len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in (text, counts))))
    columns = list(zip(*rows))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()))], PACKED)


def unpacked_phrases(phrases: bytes, counts: bytes) -> pa.Table:
    """(phrase, n) of one packed row. No phrase holds a line end, as those part the pieces."""
    text, planes = (pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in (phrases, counts))
    n = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return pa.table({"phrase": pa.array(text.split(b"\n"), pa.binary()), "n": pa.array(n, pa.int64())})


def scored(counts: DataFrame, most: int) -> DataFrame:
    """Phrases of two and more words: ``longest`` (of the longer ones around it) and the weakest ``cut``.

    Every part of a phrase asks for its count by one join. The answer goes to the phrase
    as the left or right side of a cut, and the phrase's count to the part as that of a
    longer phrase; both meet in one aggregate by row number.
    """
    named = counts.where("phrase IS NOT NULL")
    parts = F.split("phrase", " ")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size")))))
    asks = (
        named.where("words > 1").select("lang", "row", "words", "n", parts.alias("parts"), F.explode(spans).alias("s"))
        # The left side of the cut after ``size`` words, the right side of the one that leaves so many, or neither (0).
        .withColumn("spot", F.when(F.col("s.at") == 1, F.col("s.size")).when(F.col("s.at") + F.col("s.size") > F.col("words"), F.lit(most) + F.col("words") - F.col("s.size")).otherwise(0))
        .where((F.col("spot") > 0) | (F.col("s.size") > 1))
        .select("lang", F.array_join(F.slice("parts", F.col("s.at"), F.col("s.size")), " ").alias("phrase"), F.col("row").alias("whole"), "spot", F.col("n").alias("longer"))
    )
    met = asks.join(named.select("lang", "phrase", "row", "words", "n"), ["lang", "phrase"])
    told = met.select(F.explode(F.array(
        F.struct(F.when(F.col("spot") > 0, F.col("whole")).alias("row"), "spot", F.col("n").alias("n")),
        F.struct(F.when(F.col("words") > 1, F.col("row")).alias("row"), F.lit(0).alias("spot"), F.col("longer").alias("n")))).alias("t")).select("t.*")
    at = lambda k: F.max(F.when(F.col("spot") == k, F.col("n")))
    sides = told.where("row IS NOT NULL").groupBy("row").agg(
        *[at(k).alias(f"l{k}") for k in range(1, most)], *[at(most + k).alias(f"r{k}") for k in range(1, most)], at(0).alias("longest"))
    exact = "CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))"

    def cut(k: int) -> Column:
        score = F.expr(f"({exact}) div (CAST(l{k} AS DECIMAL(18,0)) * CAST(r{k} AS DECIMAL(18,0)))")
        return F.when(F.col("words") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    whole = named.where("words > 1").select("row", "lang", "phrase", "words", F.col("n").alias("a"))
    return whole.join(sides, "row").withColumn("cut", F.array_min(F.array(*[cut(k) for k in range(1, most)])))


#: Groups that a language's phrases are dealt out to before its best are ranked.
DEALS = 64


def mine(
    docs: DataFrame, threshold: int = 10, max_words: int = 3, nested_percent: int = 50, top: int = 2000,
    lang: str = "lang", text: str = "text", part_mass: int = 4_000_000, filter_bytes: int = 16 << 20,
) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``part_mass``: occurrences that one summary should bear. ``filter_bytes``: size of the
    Bloom filter that all tasks get, whatever the input.
    """
    counts = stored(frequent(docs, threshold, max_words, lang, text, part_mass, filter_bytes).withColumn("row", F.monotonically_increasing_id()))
    kept = (
        scored(counts, max_words)
        .where(F.col("longest").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longest") < F.lit(nested_percent).cast("decimal(3,0)") * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALS))).orderBy(*order)
    some = kept.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top).drop("rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("phrase IS NULL").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
