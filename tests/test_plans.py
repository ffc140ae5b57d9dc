"""Block-wise ordered computations and bounded pairing against plain reference results."""

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from chatloom.operators import clusters, perf, retrieval, telemetry
from chatloom.plans.blocks import BLOCK, even, int_block, pack_text, previous, running, streaks
from chatloom.queries import base


def _events(spark, n=400, seed=3):
    rng = random.Random(seed)
    # One key holds a third of all rows.
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(9)}", i * 7 % 1009, rng.randrange(-5, 20)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, pos bigint, v bigint")


def test_running_equals_window(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("pos")
    got = running(df, ["k"], ["pos"], int_block(F.col("pos"), 16), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    ex = w.rowsBetween(Window.unboundedPreceding, -1)
    got = running(df, ["k"], ["pos"], int_block(F.col("pos"), 16), {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}, inclusive=False)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(ex), F.lit(0))).withColumn("m", F.min("v").over(ex))
    assert got.exceptAll(want).isEmpty()


def test_previous_equals_lag(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("pos")
    got = previous(df, ["k"], ["pos"], int_block(F.col("pos"), 8), {"p": F.col("v")})
    assert got.exceptAll(df.withColumn("p", F.lag("v").over(w))).isEmpty()


def test_global_running(spark):
    df = spark.range(100).select(F.col("id").alias("pos"), F.lit(2).alias("v"))
    rows = running(df, [], ["pos"], int_block(F.col("pos"), 7), {"s": ("sum", F.col("v"))}, inclusive=False).collect()
    assert all(r.s == 2 * r.pos for r in rows)


def test_pack_text_loses_nothing(spark):
    df = _events(spark).select("k", "pos", F.concat(F.lit("t"), "pos").alias("text"))
    parts = pack_text(df, "k", "pos", "text", "|", part_chars=50, block_width=32).collect()
    want = {k: "|".join(f"t{p}" for p in sorted(r.pos for r in g)) for k, g in itertools.groupby(sorted(df.collect(), key=lambda r: r.k), key=lambda r: r.k)}
    got = {}
    for r in sorted(parts, key=lambda r: (r.k, r.part_no)):
        got[r.k] = got[r.k] + "|" + r.text if r.k in got else r.text
    assert got == want and max(len(r.text) for r in parts) < 70


def _union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by_slug = {}
    for c, s in pairs:
        find(c)
        by_slug.setdefault(s, []).append(c)
    for ids in by_slug.values():
        for other in ids[1:]:
            a, b = find(ids[0]), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {c: find(c) for c in parent}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"c{i:03d}", f"s{j}") for i in range(40) for j in (i, i + 1)]  # a long chain
    pairs += [(f"r{rng.randrange(60):02d}", f"x{rng.randrange(70)}") for _ in range(80)]
    pairs += [(f"h{i:02d}", "hub") for i in range(30)] + [("alone", "only")]
    df = spark.createDataFrame(pairs, "conv_id string, slug string")
    got = {r.conv_id: r.cluster_id for r in clusters.components(df).collect()}
    assert got == _union_find(pairs)


def _vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, dim)).astype("float32")
    rows = [(i, i // 7, [float(x) for x in v], 1.0) for i, v in enumerate(vecs)]
    qs = rng.normal(size=(5, dim))
    data = spark.createDataFrame(rows, "row_id bigint, chat_id bigint, vec array<float>, weight double").repartition(6)
    asked = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(qs)], "query_id bigint, qvec array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return data, asked, unit(vecs.astype("float64")) @ unit(qs).T


def test_retrieve_is_exact_on_both_paths(spark):
    data, asked, sims = _vectors(spark)
    want = set()
    for q in range(5):
        order = sorted((-round(s, 9), i) for i, s in enumerate(sims[:, q]) if s > 0)[:32]
        seen, out = {}, []
        for _, i in order:
            if seen.get(i // 7, 0) < 3 and len(out) < 8:
                seen[i // 7] = seen.get(i // 7, 0) + 1
                out.append(i)
        want |= {(q, i, n + 1) for n, i in enumerate(out)}
    for bounds in ({}, {"cell_bytes": 400}):
        got = {(r.query_id, r.row_id, r["rank"]) for r in retrieval.retrieve(data, asked, **bounds).collect()}
        assert got == want


def test_rank_chats_keeps_best_chunk(spark):
    data, asked, sims = _vectors(spark)
    got = retrieval.rank_chats(data, asked, 4).where("query_id = 2").orderBy("rank").collect()
    best = {}
    for i, s in enumerate(sims[:, 2]):
        best[i // 7] = max(best.get(i // 7, -9), round(s, 9))
    assert [r.chat_id for r in got] == [c for c, _ in sorted(best.items(), key=lambda x: -x[1])[:4]]


def test_keyword_hits_are_substrings(spark):
    texts = ["Alpha2 beta", "xalpha2x, beta44!", "gammawords here", "none", None, "GAMMA words", "betab eta"]
    docs = spark.createDataFrame([(i, f"2024-01-{9 - i:02d}", t) for i, t in enumerate(texts)], "doc_id bigint, update_date string, text string")
    words = ["alpha2", "beta4", "gamma", "words", "beta"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.doc_id) for r in retrieval.word_hits(frame, docs).collect()}
    assert got == {(w, i) for w in words for i, t in enumerate(texts) if w in (t or "").lower()}
    asked = spark.createDataFrame([(1, "Where is alpha2 or beta4?"), (2, "gamma WORDS")], "query_id bigint, question string")
    rows = sorted((r.query_id, r.n, r.doc_id) for r in retrieval.keyword_fallback(asked, docs, 4).collect())
    assert rows == [(1, 1, 0), (1, 2, 1), (2, 1, 2), (2, 2, 5)]


def test_keyword_search_looks_in_all_texts_for_rare_words_only(spark, monkeypatch):
    """The newest texts answer common words; all others are searched for the words that lack hits, with the same rows."""
    base = ["alpha beta gamma", "xalphax betas", "alpha", "rareword here", "beta alpha", "", None]
    given = [(i, None if i % 9 == 8 else f"2024-01-{1 + i * 7 % 28:02d}", base[i % len(base)] if i != 37 else "onceword alpha") for i in range(60)]
    given += given[:9]
    docs = spark.createDataFrame(given, "doc_id bigint, update_date string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha beta rareword"), (2, "onceword gamma"), (3, "absentword"), (4, None)], "query_id bigint, question string")
    find, searched = retrieval.word_hits, []
    monkeypatch.setattr(retrieval, "word_hits", lambda words, docs, *more: (searched.append({r.word for r in words.collect()}), find(words, docs, *more))[1])

    def places(word):
        ids = {d for d, _, t in given if word in (t or "")}
        return sorted(((d, day) for d, day, _ in given if d in ids), key=lambda x: (x[1] is None, [-ord(c) for c in x[1] or ""], x[0]))

    def best(question, k):
        words = sorted({w for w in question.split() if len(w) > 3}, key=lambda w: (-len(w), w))
        out = []
        for w in words:
            out += [d for d, _ in places(w)[:k]]
        return list(dict.fromkeys(out))[:k]

    for newest in (3, 12, 10_000):
        monkeypatch.setattr(retrieval, "NEWEST", newest)
        searched.clear()
        got = {}
        for r in retrieval.keyword_fallback(asked, docs, 3).orderBy("query_id", "n").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert got == {1: best("alpha beta rareword", 3), 2: best("onceword gamma", 3)}
        assert searched[0] == {"alpha", "beta", "gamma", "rareword", "onceword", "absentword"} and "absentword" in searched[1] and (newest < 12 or "alpha" not in searched[1])


def test_score_blocks_hold_their_bound(spark):
    """A batch of 10,000 rows and 20,000 queries is worked on in blocks of bounded size."""
    from chatloom.operators.retrieval import BLOCK_BYTES, slices

    cuts = list(slices(10_000, 20_000))
    assert max((r.stop - r.start) * (q.stop - q.start) * 8 for r, q in cuts) <= BLOCK_BYTES
    assert sum((r.stop - r.start) * (q.stop - q.start) for r, q in cuts) == 10_000 * 20_000


def test_rank_kernel_counts_chats_once():
    """Chats that go over batches and blocks count once, whatever the cuts."""
    import pandas as pd

    from chatloom.operators import evaluation

    rng = np.random.default_rng(3)
    vec, q = rng.normal(size=(300, 8)), rng.normal(size=(6, 8))
    data = pd.DataFrame({"row_id": np.arange(300), "chat_id": np.sort(rng.integers(0, 40, 300)), "vec": list(vec)})
    asked = pd.DataFrame({"query_id": range(6), "qvec": list(q), "gold_score": [0.1, 0.3, -0.2, 0.6, np.nan, 0.0], "gold_row": [3.0, 8, 9, 1, np.nan, 7]})
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(vec) @ unit(q).T, 9)
    for cuts in ([0, 300], [0, 7, 50, 51, 290, 300]):
        for block in (1 << 26, 8 * 4 * 40, 8 * 4 * 900):
            batches = [data.iloc[a:b] for a, b in zip(cuts, cuts[1:])]
            got = pd.concat(evaluation._rank_kernel(block)(iter(batches), asked))
            for j in range(6):
                want = len({c for c, s in zip(data.chat_id, sims[:, j]) if s > asked.gold_score[j]})
                assert got.n_above[j] == want and got.top1[j] == sims[:, j].max()


def test_breaker_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(i % 2, i, rng.random() > 0.5, rng.randrange(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "run bigint, seq bigint, ok boolean, usd bigint")
    for max_usd in (None, 30):
        got = {r.seq: r.skipped for r in perf.breaker(df, ["run"], "seq", F.col("ok"), "usd", int_block(F.col("seq"), 10), 4, max_usd).collect()}
        want = {}
        for run in (0, 1):
            streak = spent = 0
            tripped = False
            for _, seq, ok, usd in (r for r in rows if r[0] == run):
                want[seq] = tripped
                streak, spent = (0 if ok else streak + 1), spent + usd
                tripped = tripped or streak >= 4 or (max_usd is not None and spent >= max_usd)
        assert got == want


def test_energy_examples(spark):
    rows = [("a", float(t), 200.0) for t in range(0, 11, 5)] + [("b", 0.0, 100.0), ("b", 3600.0, 100.0), ("c", 1.0, 5.0)]
    df = spark.createDataFrame(rows, "run string, t double, w double")
    got = {r.run: r.wh for r in telemetry.energy_wh(df, ["run"], "t", "w", F.floor(F.col("t") / 3).cast("bigint")).collect()}
    assert round(got["a"], 4) == 0.5556 and got["b"] == 100.0 and got["c"] is None


def test_no_cross_join_and_no_lone_window(spark):
    """No query plan pairs tables without a key; windows without a partition only meet block totals."""
    for name in ("cosine_topk", "keyword_fallback", "index_delta", "recall_mrr", "completeness_checks"):
        plan = base.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_streaks_equal_a_loop(spark):
    df = _events(spark).withColumn("hit", F.col("v") > 2)
    for width in (1, 7, 64, 2000):
        rows = streaks(df, ["k"], ["pos"], int_block(F.col("pos"), width), F.col("hit"), "n").collect()
        at = {}
        for r in sorted(rows, key=lambda r: (r.k, r.pos)):
            at[r.k] = at.get(r.k, 0) + 1 if r.hit else 0
            assert r.n == at[r.k]


def test_even_blocks_of_a_hot_key(spark):
    """90 % of the rows lie on one key and one day; no block is above twice the aim, and results are those of plain windows."""
    rows = 40_000
    key = F.when(F.col("id") % 10 < 9, F.lit("hot")).when(F.col("id") % 100 == 9, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    at = F.when(F.col("id") % 10 < 9, F.col("id") * 2).otherwise(F.col("id") * 864)
    df = spark.range(rows).select(key.alias("key"), at.alias("t"), "id", (F.xxhash64("id") % 3 == 0).alias("hit"), (F.col("id") % 11).alias("v"))
    placed = even(df, ["key"], ["t", "id"], 2_000)
    sizes = [r["count"] for r in placed.groupBy(BLOCK).count().collect()]
    assert sum(sizes) == rows and len(sizes) >= rows // 2_000 and max(sizes) <= 2 * 2_000
    w = Window.partitionBy("key").orderBy("t", "id")
    block = F.col(BLOCK)
    got = running(placed, ["key"], ["t", "id"], block, {"sum": ("sum", F.col("v"))})
    got = previous(got, ["key"], ["t", "id"], block, {"last": F.col("v")})
    got = streaks(got, ["key"], ["t", "id"], block, F.col("hit"), "streak")
    group = F.sum((~F.col("hit")).cast("int")).over(w)
    want = df.withColumn("sum", F.sum("v").over(w)).withColumn("last", F.lag("v").over(w)).withColumn("g", group).withColumn(
        "streak", F.when(F.col("hit"), F.sum(F.col("hit").cast("int")).over(Window.partitionBy("key", "g").orderBy("t", "id"))).otherwise(0))
    columns = ["key", "id", "sum", "last", "streak"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and got.count() == rows
