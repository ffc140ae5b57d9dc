"""Answers to items, contracts, legacy records, batches, redaction."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chatloom import banks
from chatloom.functions import redact
from chatloom.operators import cards, classify, contracts, evaluation, items, perf, redaction, states
from chatloom.plans import batches
from chatloom.plans.blocks import int_block

GOOD = {
    "title": " T ", "primary_archetype": {"id": "software_app"}, "primary_domain_pair": {"domain": "finance", "subdomain": ""}, "goal": "g",
    "objectives": [{"text": " o ", "role": "Forming"}, {"text": "p", "role": "odd"}, "bare", {"role": "forming"}], "requirements": [" r ", "", 3],
    "requirements_evolution": [{"change": "c"}, {"date": "2024"}], "deliveries": [{"name": "n", "materiality": "MATERIAL", "kind": " "}],
    "secondary_archetypes": [{"id": "x"}, {"id": ""}], "confidence": "1.7", "archetype_fields": {"quickstart": "run", "key_features": ["a"]},
}
ANSWERS = [
    ("a", json.dumps(GOOD)), ("b", "Here you go: " + json.dumps({"primary_archetype": "software_app", "confidence": "bad"}) + " bye"), ("c", "no json"), ("d", "[1]"), ("e", None),
]


@pytest.fixture(scope="module")
def built(spark):
    clusters = spark.createDataFrame([(s, "knowledge_qa", "general_knowledge", None, 1, 2) for s, _ in ANSWERS], "slug string, archetype string, domain string, subdomain string, n_versions int, n_conversations int")
    answers = spark.createDataFrame([(s, a, 0.1234567, "sha") for s, a in ANSWERS], "slug string, answer string, usd double, bundle_sha string")
    return {r.slug: r for r in items.build_items(answers, clusters).collect()}


def test_good_answer(built):
    r = built["a"]
    assert (r.title, r.archetype, r.domain, r.subdomain, r.confidence, r.llm_ok, r.schema_valid) == ("T", "software_app", "finance", None, 1.0, True, True)
    assert [tuple(o) for o in r.objectives] == [("o", "forming"), ("p", None)] and r.requirements == ["r"]
    assert [tuple(e) for e in r.requirements_evolution] == [("c", None)] and [tuple(d) for d in r.deliveries] == [("n", "material", None)]
    assert len(r.secondary_archetypes) == 1 and json.loads(r.archetype_fields["key_features"]) == ["a"] and r.cost_usd == 0.123457


def test_weak_and_failed_answers(built):
    assert built["b"].archetype == "knowledge_qa" and built["b"].llm_ok and not built["b"].schema_valid and built["b"].confidence == 0.0
    for s in ("c", "d", "e"):
        assert not built[s].llm_ok and built[s].classification_source == "deterministic_prior" and built[s].title == s


def test_contract_keys(spark):
    df = spark.createDataFrame([("a", "software_app", {"quickstart": "x", "extra": "", "how_to_use": None}), ("b", "nothing", {"k": "v"})], "slug string, archetype string, archetype_fields map<string,string>")
    assert {(r.slug, r.field) for r in contracts.missing_contract_keys(df).collect()} == {("a", "how_to_update")}
    full = {r.slug: r.archetype_fields for r in contracts.with_contract_defaults(df).collect()}
    assert full == {"a": {"quickstart": "x", "how_to_use": "", "how_to_update": "", "key_features": "[]", "extra": ""}, "b": {"k": "v"}}


def test_item_contract(spark, built):
    base = spark.createDataFrame([("i", "s", "t", True, "a", "d", "g", ["c"], {"k": "v"}, "retrieve", "objective", "text", "T1", 0.5, 3, 0, 1, 1, 1, [("x", None)]),
                                  ("i", "s", None, True, "a", "d", "g", ["c"], {"k": "v"}, "fly", None, "text", "T9", 1.5, 13, 4, 1, 1, 1, [("x", "odd")])],
                                 "item_id string, slug string, title string, is_durable_project boolean, archetype string, domain string, goal string, source_conversation_ids array<string>, archetype_fields map<string,string>, "
                                 "cognitive_type string, verifiability_class string, modality string, tier string, confidence double, difficulty_score int, steps int, specialisation int, ambiguity int, context_load int, objectives array<struct<text:string,role:string>>")
    broken = {r.rule for r in contracts.violations(base, contracts.item_rules()).where("n_violations = 1").collect()}
    assert broken == {"title required", "cognitive_type enum", "tier enum", "confidence range", "difficulty_score range", "steps range", "objectives role"}


def test_dimension_contracts(spark):
    assert contracts.tier_gaps(classify.tiers(spark)).isEmpty()
    odd = spark.createDataFrame([("T1", 1, 0, 5), ("T2", 2, 5, 10)], "tier string, weight int, lo int, hi int")
    assert {(r.score, r.n_tiers) for r in contracts.tier_gaps(odd).collect()} == {(5, 2), (11, 0), (12, 0)}
    bank = spark.createDataFrame([("m", "p", True, None, "token", None), ("n", "p", False, None, "subscription", None)], "name string, provider string, skip boolean, skip_reason string, billing_kind string, plan_id string")
    bad = {r.rule for r in contracts.violations(bank, contracts.bank_rules()).where("n_violations > 0").collect()}
    assert bad == {"skip needs a reason", "subscription needs a plan"}
    state = spark.createDataFrame([("s-1", "p", "g", "1.0.0", 1, "baseline", "now"), ("-s", "p", "g", "2", 0, "odd", None)], "state_id string, project_ref string, geometry_id string, schema_version string, geometry_version int, observation_role string, observed_at string")
    assert {r.n_violations for r in contracts.violations(state, contracts.state_rules()).collect()} == {0, 1}
    tele = spark.createDataFrame([(3, 2.0, 1.0, 2.0, 3.0)], "n_samples int, duration_s double, power_w_min double, power_w_avg double, power_w_peak double")
    rest = {f"{m}_{s}": F.lit(None).cast("double") for m in banks.TELEMETRY_METRICS[1:] for s in ("min", "avg", "peak")}
    assert contracts.violations(tele.withColumns(rest), contracts.telemetry_rules()).where("n_violations > 0").isEmpty()
    ent = spark.createDataFrame([("1.2", 3, 2, 0), (None, -1, 2, 0)], "version string, mentions int, n_chats int, unstable_votes int")
    assert contracts.violations(ent, contracts.entity_rules()).agg(F.sum("n_violations")).collect()[0][0] == 2


def test_declared_columns(spark):
    declared = spark.createDataFrame([(c,) for c in set(banks.COLUMN_COORDINATES.values()) - {"COORD-B-ENERGY"}], "coordinate string")
    assert [r["column"] for r in states.undeclared_columns(banks.COLUMN_COORDINATES, declared).collect()] == ["wh_per_item"]
    assert states.undeclared_columns(banks.COLUMN_COORDINATES, declared.where("false")).isEmpty()


def test_legacy_records(spark):
    old = spark.createDataFrame([("s", None, "g", None, ["o", '{"text": "p"}', " ", '{"role": "x"}'], ["r", ""], ["c", '{"date": "d", "change": "e"}'], 0, "run", None, None, None)],
                                "slug string, project_name string, goal string, description string, objectives array<string>, requirements array<string>, requirements_evolution array<string>, n_versions int, quickstart string, how_to_use string, how_to_update string, use_case string")
    prior = spark.createDataFrame([("s", "knowledge_qa", "general_knowledge", None)], "slug string, archetype string, domain string, subdomain string")
    r = cards.from_legacy(old, prior).collect()[0]
    assert r.title == "s" and r.objectives == ["o", "p"] and r.requirements == ["r"] and not r.is_durable_project and r.archetype == "knowledge_qa"
    assert [tuple(e) for e in r.requirements_evolution] == [(None, "c"), ("d", "e")] and r.archetype_fields["quickstart"] == "run"


def test_calls_retry_and_count(spark):
    def model(system, prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        model.n = getattr(model, "n", 0) + 1
        return ("{}" if prompt == "ok" or model.n % 2 == 0 else "prose"), {"in_tok": 3, "out_tok": 1, "load_ms": 1.5}

    prompts = spark.createDataFrame([("ok",), ("boom",), ("never",)], "prompt string").coalesce(1)
    got = {r.prompt: r for r in items.complete(prompts, model, retries=1).collect()}
    assert got["ok"].attempts == 1 and got["ok"].in_tok == 3 and got["boom"].error == "down" and got["boom"].answer is None
    assert got["never"].attempts == 1 or got["never"].in_tok == 6


def test_batches(spark):
    work = spark.createDataFrame([(0, i, c) for i, c in enumerate([100, 100, 5000, 100, 100, 100])], "shard int, pos int, chars int")
    got = [r.batch for r in sorted(items.pack_batches(work, ["shard"], ["pos"], "chars", 2, 700).collect(), key=lambda r: r.pos)]
    assert got == [0, 0, 1, 2, 2, 3]
    answers = spark.createDataFrame([(0, '{"a": {"x": 1}, "b": "text"}'), (1, "junk")], "batch int, answer string")
    members = spark.createDataFrame([(0, "a"), (0, "b"), (0, "z"), (1, "c")], "batch int, slug string")
    usable, rest = items.split_batch(answers, members)
    assert [r.slug for r in usable.collect()] == ["a"] and {r.slug for r in rest.collect()} == {"b", "z", "c"}


def test_recovered_rollouts(spark):
    line = lambda role, content, kind="response_item": json.dumps({"type": kind, "payload": {"role": role, "content": content}})
    logs = [("f1", 0, line("user", "texts for slug 'one'")), ("f1", 1, line("assistant", [{"text": "first"}])), ("f1", 2, line("assistant", [{"text": '{"v": 1}'}])),
            ("f2", 0, line("user", [{"text": "for slug 'one'"}])), ("f2", 1, line("assistant", '{"v": 2}')), ("f3", 0, line("user", "for slug 'two'")), ("f3", 1, line("assistant", "prose")),
            ("f4", 0, line("user", "for slug 'four'")), ("f4", 1, line("assistant", '{"v": 4}'))]
    answers = items.rollout_answers(spark.createDataFrame(logs, "file string, line_no int, value string"), r"slug '([^']+)'")
    times = spark.createDataFrame([(f"f{i}", i) for i in range(1, 5)], "file string, mtime int")
    slugs = spark.createDataFrame([("one",), ("two",), ("four",)], "slug string")
    got, missing = items.recovered(answers, times, slugs, spark.createDataFrame([("one", "sha")], "slug string, bundle_sha string"))
    assert [(r.slug, json.loads(r.answer)) for r in got.collect()] == [("one", {"v": 2})] and [r.slug for r in missing.collect()] == ["four"]


SECRETS = [
    ("mail bob@x.org now", "mail ‹email› now"), ("-----BEGIN RSA PRIVATE KEY-----", "‹token›"), ("sk-" + "a1" * 10, "‹token›"), ("ghp_" + "a" * 24, "‹token›"),
    ("AKIA" + "A" * 16, "‹token›"), ("AIza" + "b" * 35, "‹token›"), ("xoxb-1234567890-ab", "‹token›"), ("eyJab.cd-e.f_g", "‹token›"), ("Bearer abcdefghijklmnop.q", "‹token›"),
    ("/Users/me/x y", "‹path› y"), ("/home/me/x", "‹path›"), ("C:\\Users\\me\\f", "‹path›"), ("+1 (415) 555-1234", "‹phone›"), ("(415) 555-1234", "‹phone›"), ("415-555-1234", "‹phone›"),
    ("at 192.168.0.1", "at ‹ip›"), ("version 1.2.3 and 300.1.1.1", "version 1.2.3 and 300.1.1.1"), ("source_conversation_ids", "‹token›"), ("Jane Roe met Janet", "‹redacted› met Janet"), ("id ACME-1234", "id ‹redacted›"),
]


def test_scrub(spark):
    custom = redact.dictionary(["jane roe", " "], ["ACME-\\d{4}", "(broken"])
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SECRETS)], "i int, t string")
    got = {r.i: r for r in redact.scrub_counts(df, "t", custom).collect()}
    assert {i: r.t for i, r in got.items()} == {i: w for i, (_, w) in enumerate(SECRETS)}
    assert all((r.n_findings == 0) == (SECRETS[i][0] == SECRETS[i][1]) for i, r in got.items())
    assert {r.i: r.s for r in df.select("i", redact.scrub(F.col("t"), custom).alias("s")).collect()} == {i: r.t for i, r in got.items()}


def test_nested_scrub_and_public_items(spark):
    df = spark.sql("SELECT 'a@b.co' AS k, struct('a@b.co' AS e, 3 AS n) AS s, map('a@b.co', array('a@b.co', 'x')) AS m, parse_json('{\"q\": [\"a@b.co\", 1]}') AS v")
    r = redact.scrub_frame(df, only=["s", "m", "v"]).select("k", "s.e", "s.n", "m", F.to_json("v").alias("v")).collect()[0]
    assert (r.k, r.e, r.n, r.m, json.loads(r.v)) == ("a@b.co", "‹email›", 3, {"a@b.co": ["‹email›", "x"]}, {"q": ["‹email›", 1]})
    it = spark.sql("SELECT 's' AS slug, 'mail a@b.co' AS goal, 1.0 AS cost_usd, true AS llm_ok, array(struct('x\\\\y\\\\z.zip' AS filename, '1' AS version)) AS version_zip_files")
    out = redaction.public_items(it)
    assert out.columns == ["slug", "goal", "version_zip_files"] and out.collect()[0].goal == "mail ‹email›" and out.collect()[0].version_zip_files[0].filename == "z.zip"
    assert [(r.field, r.kind) for r in redaction.review(it, "slug", ["goal", "slug"]).collect()] == [("goal", "email")]
    trace = spark.sql("SELECT 'to a@b.co' AS message, struct('/home/u/x' AS error, 5 AS in_tok) AS payload, 'a@b.co' AS run_id")
    t = redaction.scrub_trace(trace).collect()[0]
    assert (t.message, t.payload.error, t.payload.in_tok, t.run_id) == ("to ‹email›", "‹path›", 5, "a@b.co")


def test_scrub_json_of_any_shape(spark):
    """Only string values change: names, escapes, numbers and layout stay."""
    deep = "a@b.co"
    for i in range(300):
        deep = [deep] if i % 2 else {"a@b.co": deep, "n": 1}
    rows = ['{"a@b.co": "a@b.co", "p": "C:\\\\Users\\\\me\\\\f \\"q\\" /home/x/y"}', '[1, 2.50, true, null, "x\\u00e9\\n", "to a@b.co\\n: {\\"k\\": 1}"]', '"a@b.co"', "7", '{ "k" : [ "a@b.co" , { } ] }', json.dumps(deep)]
    got = [r.j for r in spark.createDataFrame([(i, j) for i, j in enumerate(rows)], "i int, j string").orderBy("i").select(redact.scrub_json(F.col("j")).alias("j")).collect()]
    assert json.loads(got[0]) == {"a@b.co": "‹email›", "p": '‹path› "q" ‹path›'}
    assert got[1].startswith('[1, 2.50, true, null, "x\\u00e9\\n"') and json.loads(got[1])[-1] == 'to ‹email›\n: {"k": 1}'
    assert got[2:5] == ['"‹email›"', "7", '{ "k" : [ "‹email›" , { } ] }']
    assert json.dumps(json.loads(got[5]), ensure_ascii=False).count("a@b.co") == 150 and "‹email›" in got[5]


def test_scrub_reads_each_text_only_for_patterns_that_can_match(spark):
    """Every pattern, also beside others and in texts without a mark, gives what a plain replacement by all of them gives."""
    texts = [t for t, _ in SECRETS] + [f"{a} {b}" for a, _ in SECRETS for b, _ in SECRETS] + [
        "bEaReR  ABCDEFGHIJKLMNOP", "Bearers abcdefghijklmnop", "x192.168.0.1", "\u0661\u0662\u0663-\u0661\u0662\u0663-\u0661\u0662\u0663\u0664", "THE the other \u00e9the", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    custom = redact.dictionary(["the"], ["[0-9]{5,}"])
    plain = F.col("t")
    for _, placeholder, regex in [("", banks.CUSTOM_PLACEHOLDER, r"(?iu)(?<!\w)the(?!\w)"), ("", banks.CUSTOM_PLACEHOLDER, "[0-9]{5,}"), *banks.REDACTION_PATTERNS]:
        plain = F.regexp_replace(plain, "(?U)" + regex, placeholder)
    assert df.where(~redact.scrub(F.col("t"), custom).eqNullSafe(plain)).count() == 0
    marked = [regex for _, _, regex in banks.REDACTION_PATTERNS if regex not in {p[2] for p in redact._UNMARKED}]
    hit = F.lit(False)
    for regex in marked:
        hit = hit | F.col("t").rlike("(?U)" + regex)
    assert df.where(hit & ~F.col("t").rlike("(?U)" + redact._MARK)).count() == 0
    # A text without a mark meets the few patterns that need none, in a plan that stays small.
    assert 0 < len(redact._UNMARKED) < 6


def test_scrub_json_with_and_without_escaped_quotes(spark):
    """Both ways to find strings agree, blanks before a colon and odd endings included."""
    rows = ['{"a@b.co" : "a@b.co", "x": ["\\\\", "a@b.co"]}', '{"k": "", "": "to a@b.co\\n"}', '"a@b.co', None, "", '["a@b.co", "say \\"a@b.co\\""]']
    got = [r.j for r in spark.createDataFrame([(i, j) for i, j in enumerate(rows)], "i int, j string").orderBy("i").select(redact.scrub_json(F.col("j")).alias("j")).collect()]
    assert got[0] == '{"a@b.co" : "‹email›", "x": ["\\\\", "‹email›"]}' and got[1] == '{"k": "", "": "to ‹email›\\n"}'
    assert got[2] == "a@b.co" and got[3] is None and got[4] == "" and json.loads(got[5]) == ["‹email›", 'say "‹email›"']


def test_egress_gate(spark):
    jobs = spark.createDataFrame([("ollama", False, False), ("openai", True, False), ("codex", False, True)], "provider string, scrub boolean, allow_raw boolean")
    assert redaction.guard_egress(jobs).count() == 3
    with pytest.raises(PermissionError):
        redaction.guard_egress(jobs.unionByName(spark.createDataFrame([("codex", False, False)], jobs.schema)))


def test_grades(spark):
    rows = [("refuse", None, None, "I could not find it", True), ("contains_all", ["A", "b"], None, "xAyB", True), ("contains_all", ["A", "q"], None, "xAyB", False), ("contains_any", ["q", "a"], None, "xAyB", True),
            ("version_equals", None, "1.23", "It is 1.23, not 2.0", True), ("version_equals", None, "2.0", "It is 1.23, not 2.0", False), ("version_equals", None, "1.23", "cannot find 1.23", False), ("odd", None, None, "x", False)]
    df = spark.createDataFrame(rows, "kind string, needles array<string>, expected string, answer string, want boolean")
    got = df.select("want", evaluation.grade(F.col("kind"), F.col("needles"), F.col("expected"), F.col("answer")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    texts = [("", True), ("Not found in chat data", True), ("No relevant excerpt.", True), ("x" * 300 + " no relevant", False), ("The answer is 4.", False)]
    df = spark.createDataFrame(texts, "a string, want boolean").select("want", evaluation.is_not_found(F.col("a")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_answer_rows(spark):
    battery = spark.createDataFrame([("q1", "contains_any", ["x"], None, ["c1"]), ("q2", "refuse", None, None, []), ("q3", "contains_any", ["x"], None, ["c9"])], "id string, grade_type string, needles array<string>, expected string, gold_chat_ids array<string>")
    answers = spark.createDataFrame([("q1", "x", None, "synthesis", 900.0), ("q2", "no information", None, "entity", 99999.0), ("q3", None, "timed out", "synthesis", 5.0)], "id string, answer string, error string, route string, elapsed_ms double")
    hits = spark.createDataFrame([("q1", "c1"), ("q3", "c1")], "id string, chat_id string")
    rows = evaluation.answer_rows(battery, answers, hits, budget_s=15)
    got = {r.id: (r.passed, r.gold_hit, r.unusable) for r in rows.collect()}
    assert got == {"q1": (True, True, False), "q2": (True, True, False), "q3": (False, False, True)}
    assert tuple(evaluation.answer_summary(rows).collect()[0]) == (3, 2, 2, 1)


def test_rubric_policies(spark):
    axes = {"A": 60, "B": 40}
    att = spark.createDataFrame([("x", "A", 100.0), ("x", "B", 50.0), ("y", "A", 100.0), ("z", "A", 90.0), ("z", "B", 90.0)], "m string, coordinate string, attainment double")
    gates = spark.createDataFrame([("x", "G1", "cap_50", False), ("x", "G2", "fail", True), ("z", "G2", "fail", False), ("z", "G1", "cap_50", False)], "m string, gate string, effect string, passed boolean")
    pick = lambda policy: {r.m: (r.base_score, r.score, r.status) for r in states.rubric_score(att, axes, gates, ["m"], policy).collect()}
    assert pick("exclude_and_report") == {"x": (80.0, 50.0, "scored"), "y": (60.0, 60.0, "scored"), "z": (90.0, 0.0, "failed")}
    assert pick("fail_closed")["y"] == (60.0, 60.0, "scored") and pick("indeterminate_if_material")["y"] == (None, None, "indeterminate")


def test_flatten_states(spark):
    df = spark.createDataFrame([("w", "m", [("V", [("C1", 50.0, "measured", [("n", 3.0)]), (None, 1.0, "measured", [])])])],
                               "workload string, model string, vector_states array<struct<vector_ref:string, coordinate_values:array<struct<coordinate_ref:string, attainment_0_100:double, measurement_status:string, native_observations:array<struct<metric:string,value:double>>>>>>")
    long = states.flatten(df)
    assert [(r.coordinate, r.attainment) for r in long.collect()] == [("C1", 50.0)]
    assert states.sweep_report(long, ["C1", "C2"]).collect()[0].asDict() == {"workload": "w", "model": "m", "C1": 50.0, "C2": None}
    name = spark.createDataFrame([("w1__m__x.json",), ("solo.json",)], "f string").select(*states.state_name(F.col("f"))).collect()
    assert [tuple(r) for r in name] == [("w1", "m__x"), ("", "solo")]


def test_exact_load_split(spark):
    rows = spark.createDataFrame([("r", 1, 10.0, 4000.0, 5000.0), ("r", 2, 4.0, 0.0, 3000.0), ("s", 1, 7.0, None, None)], "run string, sequence int, secs double, load_ms double, eval_ms double")
    got = {r.run: r for r in perf.load_split(rows, "run").collect()}
    assert (got["r"].warm_s_per_item, got["r"].load_s, got["r"].load_kind, got["r"].gen_only_s_per_item) == (5.0, 4.0, "exact", 4.0)
    assert (got["s"].warm_s_per_item, got["s"].load_s, got["s"].load_kind) == (7.0, 0.0, "est")


@pytest.mark.parametrize("size,budget", [(1, 100), (3, 40), (8, 70), (300, 2_000)])
def test_next_fit_of_any_length(spark, size, budget):
    """Keys of one row to tens of thousands, a null key, items over the budget: as if walked one by one."""
    rng = random.Random(size)
    rows = [("hot", i, rng.choice([0, 1, 5, 9, 30, 200 if i % 97 == 0 else 3])) for i in range(9_000 if size > 100 else 70_000)]
    rows += [(None, i, rng.randrange(12)) for i in range(700)] + [(f"k{n}", i, rng.randrange(40)) for n in range(40) for i in range(n * 9 % 300 + 1)]
    frame = spark.createDataFrame(rows, "run string, pos int, chars int").repartition(5)
    got = batches.next_fit(frame, ["run"], ["pos"], F.col("chars"), size, budget).collect()
    want = {}
    for run, pos, chars in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if pos == 0:
            batch, n, used = 0, 0, 0
        if n and (n >= size or used + chars > budget):
            batch, n, used = batch + 1, 0, 0
        want[run, pos] = batch
        n, used = n + 1, used + chars
    assert {(r.run, r.pos): r.batch for r in got} == want and len(got) == len(rows)
    assert batches.next_fit(frame.where("false"), ["run"], ["pos"], F.col("chars"), size, budget).count() == 0


SHAPES = [
    ({"type": "integer", "minimum": 2}, [("3", []), ("2.0", []), ("1", ["$: minimum"]), ("2.5", ["$: type"]), ('"3"', ["$: type"]), ("null", ["$: type"])]),
    ({"type": ["object", "null"], "required": ["a b"], "properties": {"a b": {"type": "boolean"}, "it's": {"enum": ["x"]}}},
     [("null", []), ("{}", ["$.a b: required"]), ('{"a b": null}', ["$.a b: type"]), ('{"a b": true, "it\'s": "y"}', ["$.it's: enum"]), ("[]", ["$: type"])]),
    ({"type": "array", "items": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^a"}}},
     [("[]", []), ('[["a"], []]', ["$[1]: minItems"]), ('[["a", "b", 1]]', ["$[0][1]: pattern", "$[0][2]: type"]), ('[["a"], {"b": 1}]', ["$[1]: type"])]),
    ({"additionalProperties": False, "properties": {"k": {}}}, [('{"k": 1}', []), ('{"z": 1, "k": 2, "y": 3}', ["$.y: unknown", "$.z: unknown"]), ("7", [])]),
]


def test_documents_against_schemas(spark):
    for schema, cases in SHAPES:
        df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(cases)], "i int, j string")
        got = {}
        for r in contracts.document_faults(df, "i", "j", schema).collect():
            got.setdefault(r.i, []).append(r.fault)
        assert got == {i: want for i, (_, want) in enumerate(cases) if want}
    broken = spark.createDataFrame([(1, "{"), (2, None), (3, "{}")], "i int, j string")
    assert [(r.i, r.fault) for r in contracts.document_faults(broken, "i", "j", {"type": "object"}).orderBy("i").collect()] == [(1, "$: json"), (2, "$: json")]
