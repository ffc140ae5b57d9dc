"""Bundles, classification, entities, ingest, dates, context blocks, evaluation, indexing."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.functions import dates, formats, text as T
from chatloom.operators import bundles, cards, catalog, chunks, classify, clusters, conversations as C, entities, evaluation, ingest, modelbank, quality, telemetry
from chatloom.session import cut


def _waterfall(needs, budget):
    alloc, left, open_ = [0] * len(needs), max(0, budget), list(range(len(needs)))
    while open_ and left > 0:
        share = left // len(open_)
        if share <= 0:
            break
        fits = [i for i in open_ if needs[i] <= share]
        if not fits:
            for i in open_:
                alloc[i] = left // len(open_)
            break
        for i in fits:
            alloc[i] = needs[i]
            left -= needs[i]
            open_.remove(i)
    return alloc


def test_fair_shares_against_rounds(spark):
    rng = random.Random(2)
    rows, budgets = [], {}
    for g in range(120):
        budgets[g] = rng.choice([0, 3, 50, 400, 5000])
        rows += [(g, i, rng.choice([1, 5, 20, 100, 900, 7000]) + rng.randrange(9), budgets[g]) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "g int, i int, need int, budget int")
    got = {(r.g, r.i): r.alloc for r in bundles.fair_shares(df, ["g"], "need", "budget").collect()}
    for g, b in budgets.items():
        mine = sorted(r[:3] for r in rows if r[0] == g)
        assert [got[(g, i)] for _, i, _ in mine] == _waterfall([n for _, _, n in mine], b), (mine, b)


def test_fair_shares_of_one_hot_group(spark):
    """A third of the rows in one group, many ties, a null group and null needs."""
    rng = random.Random(9)
    rows = [("hot", i, rng.randrange(60), 30_000) for i in range(3_000)] + [(None, i, rng.randrange(300), 9_000) for i in range(200)]
    rows += [(f"g{i % 70}", i, rng.choice([None, 0, 5, 5, 900]), 700) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, need int, budget int")
    out = bundles.fair_shares(df, ["g"], "need", "budget")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "Python" not in plan  # counts, groups, levels, members
    got = {(r.g, r.i): r.alloc for r in out.collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        needs = [r[2] or 0 for r in mine]
        # The level is where the budget is used up: whole needs below it, equal shares above.
        order, left, level = sorted(needs), mine[0][3], None
        for k, n in enumerate(order):
            share = left // (len(order) - k)
            if n > share or share <= 0:
                level, least = max(share, 0), n
                break
            left -= n
        assert [got[(g, r[1])] for r in mine] == [n if level is None or n < least else level for n in needs]


def _exports(spark):
    turns = spark.createDataFrame(
        [("c1", 0, "user", "text", "build demo-v1.zip with setup.py", None, []), ("c1", 1, "assistant", "text", "```py\nx=1\n```", "m", []),
         ("c2", 0, "user", "text", "now demo-v2.zip and a.json b.json " + "z" * 3000, None, []), ("c3", 0, "user", "text", "explain calculus homework", None, [])],
        "conv_id string, pos bigint, role string, content_type string, text string, model string, attachments array<string>")
    heads = spark.createDataFrame([("c1", "Demo app", 1.0, "2024-01-01", "2024-01-01"), ("c2", "Demo app next", 2.0, "2024-02-01", "2024-02-01"), ("c3", "Explain calculus homework", 3.0, "2024-03-01", "2024-03-01")],
                                  "conv_id string, title string, create_time double, create_date string, update_date string")
    return C.turns(turns), heads


@pytest.fixture(scope="module")
def chain(spark):
    """Turns to cards to clusters to priors, as one run would do."""
    rows, heads = map(cut, _exports(spark))
    arch, files = cut(cards.archives(rows)), cut(cards.files(rows))
    card = cut(cards.cards(heads, rows, arch, files))
    primary = cut(cards.primary_slug(heads, cards.slug_votes(arch, heads)))
    members = cut(clusters.members(card, clusters.components(clusters.edges(primary, arch))))
    c_arch, c_files = cut(clusters.cluster_archives(members, arch)), cut(clusters.cluster_files(members, files))
    facts = cut(clusters.roll_up(members, clusters.canonical_slug(members, primary), c_arch, c_files))
    prior = cut(classify.prior(facts, clusters.top_keywords(members)))
    return rows, members, c_arch, c_files, facts, prior


def test_clusters_and_priors(chain):
    rows, members, c_arch, c_files, facts, prior = chain
    got = {r.slug: r for r in prior.collect()}
    d = got["demo"]
    assert (d.n_conversations, d.n_versions, d.archetype, d.archetype_score, d.domain, d.has_code) == (2, 2, "software_app", 3.0, "software_engineering", True)
    assert [(s.archetype, s.score) for s in d.secondary] == [("runtime_package", 2.0), ("controlled_spec_or_schema", 1.0)]
    assert (d.cognitive_type, d.steps, d.context_load, d.tier, d.modality, d.verifiability_class) == ("reason_analyze", 3, 2, "T3", "mixed", "objective")
    e = got["explain-calculus-homework"]
    assert (e.archetype, e.archetype_score, e.domain, e.cognitive_type, e.tier) == ("knowledge_qa", 1.8, "education", "retrieve", "T1")


def test_whole_bundles(chain):
    rows, members, c_arch, c_files, facts, prior = chain
    title = bundles.first_n(members, ["cluster_id"], ["create_time"], "title", 1)
    files = bundles.first_n(c_files, ["cluster_id"], ["filename"], "filename", 60, note=False)
    zips = bundles.first_n(c_arch.where("is_version"), ["cluster_id"], ["version", "filename"], "filename", 1000, note=False)
    head = cut(bundles.facts_text(bundles.select_clusters(facts), title, files, zips))
    texts = cut(C.transcripts(rows)).select("conv_id", "text")
    own = members.select("cluster_id", "conv_id", "create_time", "create_date", "title").join(texts, "conv_id")
    out = {r.slug: r for r in bundles.bundles(head, own, budget=1500).collect()}
    assert set(out) == {"demo"} and "...(+1 more)" in out["demo"].text
    text = out["demo"].text
    assert text.index("conversation c1") < text.index("conversation c2") and text.endswith(bundles.CUT_NOTE)
    assert "‹code py 1ln :: x=1›" in text and out["demo"].chars == len(text)
    assert len(text) - len(bundles.CUT_NOTE) <= 1500
    small = bundles.bundles(head, own, budget=1500, part_chars=50)
    assert "".join(r.text for r in small.orderBy("part_no").collect()) == text and small.count() == 2
    one = bundles.bundle_index(bundles.bundles(head, own, budget=1500)).collect()[0]
    assert one.bundle_sha == hashlib.sha256(text.encode()).hexdigest() and one.chars == len(text)


def test_entities(spark):
    p = entities.Product("acme", "profile", "ACME")
    rec = [(f"c{i}", i, "t", "we ship acme-profile-v1.23 today") for i in range(6)]
    rec += [("c7", 7, "acme_profile 2.0", "Acme-profile news. Do not approve v2.0 yet! ok"), ("c8", 8, "", "package_version = \"2.0.1\" for acme profile"),
            ("c9", 9, "", "profile v1.24 once"), ("c10", 10, "", "ACME (The Agentic Catalog Metric Engine) and agentic catalog metric engine (ACME)"), ("c11", 11, "", "acme stands for All Cats Meow Early; plain 9.9")]
    found = entities.mentions(spark.createDataFrame(rec, "chat_id string, pos int, title string, text string"), p)
    vers = {r.version: r for r in entities.versions(found).collect()}
    assert (vers["1.23"].mentions, vers["1.23"].n_chats, vers["1.23"].unstable_votes) == (6, 6, 0)
    assert vers["2.0"].unstable_votes == 1 and vers["2.0"].evidence == "Do not approve v2.0 yet!" and "9.9" not in vers
    ver = {r.kind: r for r in entities.verdicts(entities.versions(found)).collect()}
    assert ver["newest"].version == "2.0" and not ver["newest"].stable and ver["latest_stable"].version == "1.23"
    acr = entities.acronym(found, p)
    assert acr.collect()[0].expansion == "Agentic Catalog Metric Engine"
    qs = [("q1", "What is the newest acme-profile version overall?"), ("q2", "Which is the latest stable version?"), ("q3", "Why is the latest version not stable?"),
          ("q4", "what does ACME stand for?"), ("q5", "what is the acme version"), ("q6", "define acme")]
    ans = {r.id: r for r in entities.route(spark.createDataFrame(qs, "id string, question string"), entities.verdicts(entities.versions(found)), acr, p).collect()}
    assert ans["q1"].answer == '2.0 is the newest acme-profile version overall, but it is not stable: "Do not approve v2.0 yet!". The latest stable release is 1.23.'
    assert ans["q2"].answer == "1.23 is the latest stable acme-profile version. 2.0 is newer but not stable." and ans["q2"].chat_id == "c0"
    assert set(ans) == {"q1", "q2", "q4", "q6"} and ans["q6"].answer == "ACME stands for Agentic Catalog Metric Engine."


def test_product_stem(spark):
    """Texts that shorten the second word are about the product; other endings are not versions of it."""
    p = entities.Product("acme", "profile", "ACME", stem="profil")
    rows = [("acme-profil v1.4 ships", ["1.4"], []), ("the acme profils: v1.4 is unstable", [], ["1.4"]), ("acme-profile-v2.0.1", ["2.0"], []), ("profil v3.1", [], []), ("v1.4 is unstable", [], [])]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = df.select(entities.qualified_versions(F.col("t"), p).alias("v"), entities.unstable_versions(F.col("t"), p).alias("u")).collect()
    assert [(list(r.v), list(r.u)) for r in got] == [(v, u) for _, v, u in rows]
    kit = entities.Product("acme", "kit", "AK")
    assert not spark.range(1).select(entities.qualified_versions(F.lit("acme ki 1.2"), kit)).first()[0]


def test_question_intents(spark):
    p = entities.Product("acme", "profile", "ACME")
    cases = {
        "What is the newest version, and is it stable?": ("newest", None), "which release is the current stable one": ("latest_stable", None),
        "What is the latest profile?": ("newest", None), "how stable is the latest version": (None, None), "the latest version?": (None, None),
        "What's the highest release overall?": ("newest", None), "what is unstable in the current release": ("latest_stable", None),
        "What does ACME stand for?": (None, "acronym"), "  explain the acme acronym ": (None, "acronym"), "what is acme?": (None, "acronym"),
        "what is the acme version": (None, None), "define acme-profile": (None, None), None: (None, None),
    }
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, q string")
    got = {r.i: (r.v, r.d) for r in df.select("i", entities.version_intent(F.col("q")).alias("v"), entities.definition_intent(F.col("q"), p).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_version_order(spark):
    df = spark.createDataFrame([("1.4",), ("2.0",), ("1.23",), ("x",)], "v string")
    assert [r.v for r in df.orderBy(entities.version_key(F.col("v"))).collect()] == ["x", "1.4", "1.23", "2.0"]


def test_ingest_against_a_loop(spark):
    rng = random.Random(4)
    store = {f"k{i}": float(rng.randrange(9)) for i in range(4)}
    rows = [(rng.choice([None, "hot", "hot"] + [f"k{i}" for i in range(8)]), float(rng.randrange(12)) if rng.random() > 0.1 else None, i, f"z{i % 3}") for i in range(200)]
    want_status, have = {}, dict(store)
    origin = {k: -1 for k in store}
    for k, ut, i, _ in rows:
        if k is None:
            want_status[i] = "no_id"
        elif k in have and have[k] >= (ut or 0):
            want_status[i] = "skipped"
        else:
            want_status[i] = "updated" if k in have else "added"
            have[k], origin[k] = ut or 0, i
    batch = spark.createDataFrame(rows, "id string, ut double, ord bigint, zip string")
    old = spark.createDataFrame(list(store.items()), "id string, ut double")
    out = ingest.outcomes(batch, old, "id", "ut", "ord", width=16)
    assert {r.ord: r.status for r in out.collect()} == want_status
    seen = ingest.tallies(out, ["zip"]).agg(F.sum("seen"), F.sum("written")).collect()[0]
    assert tuple(seen) == (200, sum(s in ("added", "updated") for s in want_status.values()))
    stored = old.withColumn("ord", F.lit(-1).cast("bigint")).withColumn("zip", F.lit("old"))
    merged = ingest.newest_wins(batch, stored, "id", "ut", "ord").collect()
    assert {r.id: r.ord for r in merged} == origin


def test_dates_and_labels(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01",), ("2024-01-01 junk",), ("bad",), (None,), ("2025-06-01",)], "d string")
    now = F.lit("2024-12-31 00:00:00").cast("timestamp")
    w = [round(r[0], 3) for r in df.select(dates.recency_weight(dates.parse_when(F.col("d")), now, 365)).collect()]
    assert w == [0.5, 0.5, 0.5, 1.0, 1.0, 1.0]
    assert df.select(dates.recency_weight(dates.parse_when(F.col("d")), now, 0)).distinct().count() == 1
    e = spark.createDataFrame([("1700000000.5",), ("0",), ("x",), (None,)], "e string").select(dates.epoch_to_date(dates.number(F.col("e")))).collect()
    assert [r[0] for r in e] == ["2023-11-14", None, None, None]
    s = spark.createDataFrame([(0.0001, 100), (0.003, 2048), (0.9, 5 * 1024**2), (14.2, 3 * 1024**4)], "s double, b bigint")
    got = [tuple(r) for r in s.select(formats.duration(F.col("s")), formats.file_size(F.col("b"))).collect()]
    assert got == [("<1ms", "100 B"), ("3ms", "2.0 KB"), ("0.9s", "5.0 MB"), ("14s", "3.0 TB")]
    p = spark.createDataFrame([(60.0,), (600.0,), (7200.0,)], "s double").select(formats.planned_duration(F.col("s"))).collect()
    assert [r[0] for r in p] == ["~60s", "~10 min", "~2.0 hr"]


def _plan(matches, total, before, after, context, max_parts, max_lines, reverse):
    if context is not None:
        extra = max(context - 1, 0)
        before, after = extra // 2, extra - extra // 2
    parts = [(m, max(1, m - before), min(total, m + after)) for m in matches]
    if max_parts and len(parts) > max_parts:
        parts = parts[-max_parts:] if reverse else parts[:max_parts]
    if not max_lines:
        return parts
    if context is not None and context <= 1:
        return parts[-max_lines:] if reverse else parts[:max_lines]
    out, used = [], 0
    for m, s, e in reversed(parts) if reverse else parts:
        room = min(max_lines - used, e - s + 1)
        if room <= 0:
            break
        out.append((m, e - room + 1, e) if reverse else (m, s, s + room - 1))
        used += room
    return out[::-1] if reverse else out


@pytest.mark.parametrize("args", [(8, 3, None, 0, 0, False), (1, 1, None, 2, 0, True), (2, 2, 4, 0, 7, False), (2, 2, 5, 0, 7, True), (0, 0, 1, 0, 2, True), (1, 0, None, 3, 4, True)])
def test_context_windows(spark, args):
    text = "\n".join("hit" if i in (1, 4, 5, 12, 19, 20) else f"line {i}" for i in range(1, 21))
    before, after, context, max_parts, max_lines, reverse = args
    df = spark.createDataFrame([("d", text), ("none", "x\ny")], "k string, t string")
    got = catalog.context_windows(df, "k", "t", "hit", before, after, context, max_parts, max_lines, reverse).orderBy("p").collect()
    want = _plan([1, 4, 5, 12, 19, 20], 20, *args)
    assert [(r.matched_line, r.start, r.end) for r in got] == want and all(r.total_found == 6 for r in got)
    assert all(r.block == "\n".join(text.split("\n")[r.start - 1 : r.end]) for r in got)


def test_search_scopes(spark):
    df = spark.createDataFrame([("1", "T", "2024", "has usage_events here\nnext", []), ("2", "usage", "2025", "none", []), ("3", "T", None, "none", ["my_usage.md", "x"]), ("4", "T", None, "étusage", [])],
                               "id string, title string, update_date string, text string, files array<string>")
    rows = {r.id: (r.matched_in, r.snippet) for r in catalog.search_texts(df, "usage", scope_all=True).collect()}
    assert rows == {"1": ("text", "has usage_events here"), "2": ("title", "usage"), "3": ("file", "my_usage.md"), "4": ("text", "étusage")}
    assert {r.id for r in catalog.search_texts(df, "USAGE*", scope_all=False, ignore_case=True, word=True).collect()} == {"1"}
    assert catalog.search_texts(df, "usage", word=True).isEmpty()
    assert [r.id for r in catalog.search_files(df, "*.MD", "files", "files", ignore_case=True).collect()] == ["3"]
    titles = spark.createDataFrame([("a", "Deep Dive"), ("b", "other")], "cluster_id string, title string")
    cl = spark.createDataFrame([("a", "x-y"), ("b", "deep-z"), ("c", "q")], "cluster_id string, slug string")
    assert {r.cluster_id for r in catalog.cluster_matches(cl, titles, "deep").collect()} == {"a", "b"}
    assert {r.cluster_id for r in catalog.cluster_matches(cl, titles, "deep*").collect()} == {"a", "b"}
    assert catalog.cluster_matches(cl, titles, "dee").count() == 2 and catalog.cluster_matches(cl, titles, "dee?").isEmpty()


def test_spans(spark):
    got = spark.createDataFrame([("ab1cd22",), ("none",)], "t string").select(T.match_spans(F.col("t"), "[0-9]+")).collect()
    assert [tuple(x) for x in got[0][0]] == [(2, 3, "1"), (5, 7, "22")] and got[1][0] == []


def test_weighted_accuracy_example(spark):
    rows = [("m", "a", True, "x", "d", "objective", "T1", "retrieve"), ("m", "b", True, "x", "d", "rubric", "T4", "explain"), ("m", "c", True, "x", "d", "subjective", "T2", "explain"), ("m", "z", False, "x", "d", "objective", "T1", "retrieve")]
    it = spark.createDataFrame(rows, "model string, slug string, success boolean, archetype string, domain string, verifiability_class string, tier string, cognitive_type string")
    key = spark.createDataFrame([("a", "x", "d"), ("b", "y", "d"), ("c", "y", "d"), ("z", "x", "d")], "slug string, ref_archetype string, ref_domain string")
    g = quality.graded(it, key)
    assert quality.weighted_accuracy(g, ["model"]).collect()[0].iq == 20.0
    assert {(r.tier, r.pct) for r in quality.accuracy_by(g, ["model"], "tier").collect()} == {("T1", 100.0), ("T4", 0.0)}


def test_incremental_index(spark):
    docs = spark.createDataFrame([("a", "A", "2024", "x" * 1500), ("b", "B", "2024", "short text"), ("c", "C", "", "  ")], "id string, title string, update_date string, text string")

    def indexed(df):
        h = chunks.content_hash(F.col("title"), F.col("update_date"), F.col("text"))
        w = chunks.windows(df.withColumn("hash", h))
        return w.join(w.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks")), "id")

    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    first = chunks.embed(indexed(docs).withColumn("_in", F.col("text")), "_in", model).cache()
    assert first.count() == 3 and seen.value == 3
    changed = docs.withColumn("text", F.when(F.col("id") == "b", F.lit("new text!")).otherwise(F.col("text")))
    again = chunks.refresh(indexed(changed), first, "id", model).cache()
    assert again.count() == 3 and seen.value == 4
    assert again.where("id = 'b'").collect()[0].vec[0] == len("B (2024)\nnew text!")
    bad = chunks.embed(docs, "text", lambda t: [])
    with pytest.raises(Exception, match="vectors for"):
        bad.collect()


def test_default_embedder_is_stable():
    v = chunks.hashed_words(16)(["a b a", ""])
    assert v[0].sum() == 3 and v[1].sum() == 0 and np.array_equal(v[0], chunks.hashed_words(16)(["b A a"])[0])


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(3210))
    for n in (1, 1199, 1200, 1201, 2200, 2201, 3210):
        rows = chunks.windows(spark.createDataFrame([(text[:n],)], "text string")).orderBy("start").collect()
        want, s = [], 0
        while True:
            want.append((s, min(s + 1200, n)))
            if s + 1200 >= n:
                break
            s += 1000
        assert [(r.start, r.end) for r in rows] == want and all(r.text == text[r.start : r.end] for r in rows)


def test_bank_labels_and_board(spark):
    a = spark.createDataFrame([("p", "m", "1"), ("p", " ", "x")], "provider string, name string, v string")
    got = modelbank.merge(a, a.withColumn("v", F.lit("2")).where("name = 'm'"), a.withColumn("v", F.lit("3"))).collect()
    assert [tuple(r) for r in got] == [("p", "m", "2")]
    gen = spark.createDataFrame([("g", True, 100.0, True, 1.5), ("cloud", False, 5.0, None, None)], "label string, available boolean, power_w_avg double, throttled boolean, per_item double")
    emb = spark.createDataFrame([("e", 2.5)], "label string, per_item double")
    rows = {r.label: r for r in telemetry.device_board(gen, emb).collect()}
    assert rows["g"].avg_w == 100.0 and rows["cloud"].avg_w is None and rows["e"].per_item_label == "Wh/1k"
    cost = formats.benchmark_summary({"completed": F.lit(3), "n_items": F.lit(4), "sec_per_item": F.lit(2.55), "usd_per_1k_items": F.lit(0.0)})
    assert spark.range(1).select(cost).collect()[0][0] in ("compl 3/4 · 2.5 s/item", "compl 3/4 · 2.6 s/item")


def test_scope_and_log(spark):
    rec = spark.range(50).withColumnRenamed("id", "cid")
    gold = spark.createDataFrame([(3,), (4,)], "cid bigint")
    assert evaluation.scope(rec, gold, "cid", None).count() == 50
    a = {r.cid for r in evaluation.scope(rec, gold, "cid", 10, seed=1).collect()}
    assert len(a) == 12 and {3, 4} <= a and a == {r.cid for r in evaluation.scope(rec.repartition(7), gold, "cid", 10, seed=1).collect()}
    runs = spark.createDataFrame([("r1", "2024-01-02"), ("r2", "2024-01-01")], "label string, updated string")
    assert tuple(catalog.runs_summary(runs).collect()[0]) == (2, "r1")
