"""Phrases, table-based encoding and centroids on odd rows, against brute force and the tiktoken library."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from chatloom.llm import centroids, phrases, table_bpe
from chatloom.llm.common import Memo, stored
from chatloom.llm.queries import QUERIES

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


# phrases


def phrase_rows(seed=5):
    rng = random.Random(seed)
    vocab = ["red", "Green", "blue", "new york", "los angeles", "a,b", "x\ty", "ünï", "na me", "The", "end."]
    rows = [(None, None), ("en", ""), ("en", " \n\t .,;"), (None, "New York new york " * 12), ("und", "new york"), ("fr", "word " * 15), ("de", "ab, ab: ab! " * 9)]
    rows += [(rng.choice(["en", "fr", None]), " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 90)))) for _ in range(60)]
    rows += [("en", "one two three four")] * 11 + [("en", "one two three")] * 3 + [("en", "two three")] * 20
    rows.append(("en", " ".join(rng.choice(vocab) for _ in range(20_000))))
    return rows


def phrases_brute(rows, threshold, most=3, percent=50, top=2000):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, most + 1):
                f.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    out = []
    for (lang, words), a in found.items():
        inside = any(
            len(w) > len(words) and l == lang and 100 * b >= percent * a and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))
            for (l, w), b in found.items())
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(words), a, l, r, totals[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, seen = [], Counter()
    for lang, phrase, *rest in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, *rest))
    return ranked


@pytest.fixture(scope="module")
def spoken(spark):
    frame = spark.createDataFrame(phrase_rows(), "lang string, text string")
    for c in ("phrase", "words", "n", "part", "_text", "rank", "a", "counters"):
        frame = frame.withColumn(c, F.lit("clash"))
    return stored(frame.repartition(4))


@pytest.mark.parametrize("options", [{}, {"threshold": 3, "max_words": 4, "top": 25}, {"threshold": 12, "part_mass": 200, "filter_bytes": 64}])
def test_phrases(spoken, options):
    names = {"threshold": "threshold", "max_words": "most", "top": "top"}
    want = phrases_brute(phrase_rows(), **{"threshold": 10} | {names[k]: v for k, v in options.items() if k in names})
    got = phrases.mine(spoken, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert phrases.mine(spoken.where("false")).count() == 0


def test_phrases_of_long_texts_in_blocks(monkeypatch):
    """A text cut anywhere gives the n-grams of the whole text, once each."""
    rng = random.Random(2)
    for marks in ("", ".", "\n"):
        text = "".join(rng.choice(["ab", "c", " ", " ", "\t", "  ", *marks]) for _ in range(3000)).encode()
        for limit in (7, 50, 400, 10_000):
            got = Counter()
            total = 0
            for data, context in phrases.blocks([text, b"", b"ab c", text[:20]], 3, limit):
                grams = phrases.Grams(data, context, 3, 1)
                total += grams.total
                for n, (_, _, counts, _) in enumerate(grams.levels, 1):
                    got.update(dict(zip(grams.texts(n, np.flatnonzero(counts)).to_pylist(), counts[counts > 0].tolist())))
            want = Counter()
            for t in (text, b"ab c", text[:20]):
                for piece in re.split(rb"[.\n]", t):
                    words = re.findall(rb"[^ \t]+", piece)
                    for n in (1, 2, 3):
                        want.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
            assert got == want and total == sum(v for k, v in want.items() if b" " not in k)


def test_summary_keeps_every_frequent_gram():
    rng = np.random.default_rng(1)
    stream = np.concatenate([np.repeat(np.arange(50, dtype=np.uint64), 10), rng.integers(1000, 10**9, 6000).astype(np.uint64)])
    rng.shuffle(stream)
    summary = phrases.Summary(len(stream) // 10 + 1)
    for part in np.array_split(stream, 40):
        summary.add(*phrases.summed(part, np.ones(len(part), np.int64)))
        summary.merge()
        assert len(summary.hashes) <= summary.capacity
    assert summary.lost < 10 and set(range(50)) <= set(summary.frequent(10).tolist())
    lower, counts = phrases.summed(rng.integers(0, 2**32, 1000).astype(np.uint64), rng.integers(1, 10**12, 1000))
    assert all((x == y).all() for x, y in zip(phrases.unpack(phrases.pack(lower, counts)), (lower, counts)))


# encoding


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tables():
    return table_bpe.Tables(RANKS, PATTERN)


def test_long_pieces(tables, library):
    rng = random.Random(1)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["a" * n for n in (*range(1, 70), 500)] + ["ab" * 200, "=" * 1000, "the" * 100, " " * 300 + "x", "日本語" * 80, "aab" * 100 + "z", "z" + "a" * 333 + "t", "\n \n" * 99]
    texts += [of("abcde", 700), of("ab", 900), of("theinganr", 2000), of("01", 500), of("-_", 400), of("=a-", 300), of("éü", 200), of("\x00\x01ÿ", 200)]
    got = tables.encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:40]
    assert tables.decode([np.frombuffer(i, "<u4").astype(np.int32) for i in got]) == [t.encode() for t in texts]


def test_table_bpe_in_spark(spark, library):
    rng = random.Random(3)
    words = ["alpha", " Beta", "γάμμα", "it's", " 1234", "\n\n", "  ", "日本", "<|endoftext|>", "😀", "...", "Xyzzyxq"]
    texts = [None, "", " ", "word", "".join(rng.choice(words) for _ in range(30_000)), "q" * 3000] + ["".join(rng.choice(words) for _ in range(rng.randrange(50))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "word"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("ids", "n_tokens", "decoded", "_text", "word", "pos"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs = stored(docs.repartition(3))
    got = table_bpe.decode(table_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert table_bpe.encode(docs.where("false"), RANKS, PATTERN).count() == 0


def test_op11(spark, library):
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        ids = library.encode_ordinary(r.text or "")
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids) and mine.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_memo_is_bounded():
    memo, asked = Memo(20_000), Counter()

    def work(keys):
        asked.update(keys)
        return [k.encode() for k in keys]

    for i in range(300):
        get = memo.learn({"hot", f"k{i}", f"k{i + 1}"}, work)
        assert get("hot") == b"hot" and get(f"k{i}") == f"k{i}".encode()
        assert len(memo.new) + len(memo.old) < 200
    assert asked["hot"] == 1


# centroids


def centroids_brute(vectors, clusters=8, rounds=10, size=64, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    rows = [(i, *near(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, k, d in rows:
        own[k] += d
    return sorted(((i, k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in rows), key=str)


def vectors(n, size, seed=1):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(i % 3, 1)) for _ in range(size)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(9)] + [(7, rows[8][1]), (None, rows[2][1])]
    odd = [None, [], [0.5] * (size - 1), [0.5] * (size + 1), [None] + [0.5] * (size - 1), [math.nan] + [0.5] * (size - 1), [math.inf] * size]
    return rows + [(10_000 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize("n,size,clusters", [(150, 64, 8), (30, 4, 3), (2, 4, 40)])
def test_centroids(spark, n, size, clusters):
    rows = vectors(max(n, 9), size)
    if n == 2:
        rows = rows[:2] + rows[-7:]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, cluster string, q int").repartition(3)
    got = centroids.cluster(frame, clusters=clusters, size=size, rounds=4)
    got = got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("c"))
    assert dict(got.dtypes) | {"c": "string"} == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "c": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == centroids_brute(rows, clusters, 4, size)


def test_centroids_without_vectors(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id bigint, embedding array<float>")
    got = centroids.cluster(frame)
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(huge, size=2)
