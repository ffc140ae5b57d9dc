"""Archives, run outputs, traces and sinks on small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chatloom.operators import chunks, ingest, quality, telemetry
from chatloom.sources import archives, sinks, tables

CONV = {"title": "t", "mapping": {}}


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body if isinstance(body, (str, bytes)) else json.dumps(body))


@pytest.fixture()
def exports(tmp_path):
    d = tmp_path / "zips"
    d.mkdir()
    _zip(d / "sharded.zip", {
        "x/conversations-000.json": [CONV | {"id": "a"}, {"noise": 1}, CONV | {"id": "b"}],
        "x/conversations-001.json": "[{\"title\": \"half\", \"id\": \"c\"}, {\"tit",
        "x/conversations-002.json": {"what": "ever"},
        "x/user.json": {"email": "e"},
    })
    _zip(d / "wrapped.zip", {"export.json": "\ufeff" + json.dumps({"meta": 1, "conversations": [CONV | {"id": "d"}]}), "user_settings.json": [1] * 999})
    _zip(d / "by_id.zip", {"big.json": {"k1": CONV | {"id": "e"}, "k2": CONV | {"id": "f", "title": "ü" * 10}}, "small.json": []})
    return str(d)


def test_landing(spark, exports):
    listed = archives.files(spark, exports)
    shards = archives.pick_shards(archives.members(listed))
    assert {r.member.rsplit("/")[-1] for r in shards.collect()} == {
        "conversations-000.json", "conversations-001.json", "conversations-002.json", "export.json", "big.json",
    }
    landed = archives.land(shards).cache()
    ids = {json.loads(r.conversation)["id"] for r in archives.conversations(landed).collect()}
    assert ids == {"a", "b", "c", "d", "e", "f"}
    acc = {r.path.rsplit("/")[-1]: (r.shards_total, r.shards_parsed) for r in archives.shard_accounting(landed).collect()}
    assert acc == {"sharded.zip": (3, 2), "wrapped.zip": (1, 1), "by_id.zip": (1, 1)}
    with pytest.raises(ValueError):
        archives.conversations(landed.where("conversation IS NULL"))


def test_elements_stream_in_small_steps():
    body = json.dumps([CONV | {"id": str(i), "title": "x" * i} for i in range(30)], indent=1)
    got = [json.loads(t)["id"] for t in archives._elements(io.StringIO(body), chunk=7)]
    assert got == [str(i) for i in range(30)]


def test_fingerprints_and_ledger(spark, exports, tmp_path):
    fp = archives.fingerprints(spark, exports).cache()
    rows = {r.basename: r for r in fp.collect()}
    assert len({r.content_hash for r in rows.values()}) == 3
    known = fp.where("basename = 'by_id.zip'")
    renamed = known.withColumn("basename", F.lit("other.zip"))
    same_name = fp.where("basename = 'wrapped.zip'").withColumn("content_hash", F.lit("changed"))
    left = ingest.unprocessed(fp, renamed.unionByName(same_name)).collect()
    assert [r.basename for r in left] == ["sharded.zip"]
    cache = known.select("content_hash", "basename", "size", F.explode(F.array(F.lit("e"), F.lit("f"))).alias("conv_id"))
    assert {r.conv_id for r in ingest.cached_ids(fp, cache).collect()} == {"e", "f"}
    assert ingest.cached_ids(fp, cache.withColumn("size", F.col("size") + 1)).isEmpty()
    total = archives.sizes(spark, exports, 1).agg(F.sum("bytes")).collect()[0][0]
    assert total == sum(r["size"] for r in rows.values())


def test_outputs_of_both_generations(spark, tmp_path):
    new = {"provider": "p", "model": "m", "items": [
        {"slug": "a", "goal": "g", "llm_ok": True, "objectives": [{"text": "o"}], "requirements": ["r"], "archetype_fields": {"k": "v", "l": []},
         "primary_archetype": {"id": "app"}, "primary_domain_pair": {"domain": "d"}}, {"goal": ""}]}
    old = {"generated_by": "legacy:x (2024)", "projects": [{"slug": "b", "goal": "h", "objectives": ["x", "y"], "quickstart": "run"}]}
    d = tmp_path / "runs" / "r1"
    d.mkdir(parents=True)
    (d / "new.json").write_text(json.dumps(new))
    (d / "old.json").write_text(json.dumps(old))
    rows = {r.slug: r for r in tables.outputs(spark, str(d)).collect()}
    assert rows["a"].model == "p:m" and rows["a"].archetype == "app" and rows["_1"].archetype is None
    assert rows["b"].model == "legacy:x" and rows["b"].generation == "projects"
    q = {r.model: r for r in quality.quality_rows(quality.measured(tables.outputs(spark, str(d))), ["model"]).collect()}
    assert q["p:m"].completion_pct == 50 and q["p:m"].archetype_fields_pct == 50 and q["p:m"].objectives_pct == 33


def test_traces_and_telemetry(spark, tmp_path):
    d = tmp_path / "runs" / "r7"
    d.mkdir(parents=True)
    event = {"run_id": "m", "sequence": 1, "event_type": "LLM_OK", "payload": {"secs": 2.0, "in_tok": 5}}
    (d / "trace.jsonl").write_text(json.dumps(event) + "\nnot json\n")
    rows = tables.traces(spark, [str(d), str(d)]).collect()
    assert [(r.run_id, r.payload.secs, r.run_label) for r in rows if r.event_type] == [("m", 2.0, "r7")]
    (d / "gpu.jsonl").write_text('{"t": 1, "w": 100}\n{"t": 2, "power_w": 50, "temp_c": 70}\n')
    assert sorted(r.power_w for r in tables.telemetry(spark, str(d / "gpu.jsonl")).collect()) == [50.0, 100.0]
    assert {r.run_label for r in tables.run_labels(spark, str(tmp_path / "runs"), "trace.jsonl").collect()} == {"r7"}


def test_battery_and_logs(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": "q1", "question": "?", "grade": {"type": "refuse"}}\n{"id": "q2", "query": "!", "expected": "1.2", "gold_chat_ids": ["c"]}\n')
    rows = {r.id: r for r in tables.battery(spark, str(tmp_path / "b.jsonl")).collect()}
    assert rows["q1"].grade_type == "refuse" and rows["q2"].question == "!" and rows["q2"].gold_chat_ids == ["c"]
    (tmp_path / "run.log").write_text("ok\nCUDA oops\nfine\n")
    lines = tables.log_lines(spark, str(tmp_path / "run.log"))
    assert [r.line for r in lines.orderBy("pos").collect()] == ["ok", "CUDA oops", "fine"]
    assert [r.line for r in telemetry.log_errors(lines, "file", "pos", "line").collect()] == ["CUDA oops"]


def test_run_tables_and_latest(spark, tmp_path):
    root = str(tmp_path / "lake")
    for run, n in (("r1", 3), ("r2", 5)):
        sinks.run_table(spark.range(n), root, "cards", run)
        sinks.register_run(spark, root, run, f"2024-01-0{n}")
    sinks.run_table(spark.range(4), root, "cards", "r1")  # a rerun replaces its own partition only
    assert sinks.read_run_table(spark, root, "cards", "r1").count() == 4
    assert sinks.read_run_table(spark, root, "cards", sinks.resolve_run(spark, root, "latest")).count() == 5


def test_index_generations(spark, tmp_path):
    root = str(tmp_path / "idx")
    assert sinks.current_index(spark, root, chunks.SCHEMA_TAG) is None
    sinks.index(spark.range(2), root, chunks.SCHEMA_TAG)
    sinks.index(spark.range(3), root, chunks.SCHEMA_TAG)
    assert sinks.current_index(spark, root, chunks.SCHEMA_TAG).count() == 3
    assert sinks.current_index(spark, root, "other") is None


def test_bundle_and_state_sinks(spark, tmp_path):
    b = spark.createDataFrame([("c1", "s", 1, 0, "text\nof one", 11), ("c2", "s", 1, 0, "two", 3), ("c2", "s", 1, 1, "more", 4)], "cluster_id string, slug string, n_conversations int, part_no int, text string, chars int")
    root = tmp_path / "bundles"
    sinks.bundle_texts(b, str(root))
    sinks.bundle_texts(b.where("cluster_id = 'c2'"), str(root))
    kept = spark.read.parquet(str(root / "texts")).orderBy("part_no").collect()
    assert [tuple(r) for r in kept] == [("c2", 0, "two"), ("c2", 1, "more")]
    sinks.export_texts(spark, str(root / "texts"), "cluster_id", ["c2", "none"], "text", str(tmp_path / "files"))
    files = sorted((tmp_path / "files").glob("cluster_id=c2/part_no=*/*.txt"))
    assert [f.read_text() for f in files] == ["two\n", "more\n"]
    row = spark.read.parquet(str(root / "index")).collect()[0]
    assert (row.cluster_id, row.chars, row.n_parts) == ("c2", 7, 2)
    st = spark.createDataFrame([("w", "m", 1.0)], "workload string, model string, v double")
    sinks.states(st, str(tmp_path / "st"))
    sinks.states(st.withColumn("model", F.lit("n")), str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "st")).count() == 2


def test_markdown(spark):
    row = spark.sql("""SELECT 's' AS slug, 'T' AS title, 'app' AS archetype, 'why' AS archetype_rationale, 'd' AS domain, NULL AS subdomain, true AS is_durable_project,
        array(struct('x' AS id)) AS secondary_archetypes, '2024' AS start_date, CAST(NULL AS STRING) AS end_date, 2 AS n_passes, 3 AS n_conversations, '' AS goal,
        array(struct('o1' AS text, 'forming' AS role)) AS objectives, map('k', 'v', 'l', '["a","b"]', 'e', '') AS archetype_fields,
        array(struct(CAST(NULL AS STRING) AS date, 'c' AS change)) AS requirements_evolution, array(struct('f.zip' AS filename, '1' AS version)) AS version_zip_files""")
    text = row.select(sinks.markdown()).collect()[0][0]
    for part in ("# T", "`app` — why", "_Not set._", "- o1 _(forming)_", "- **l:**\n  - a\n  - b", "- **?:** c", "- `f.zip` (v1)", "yes", "2024 → ?"):
        assert part in text, part
    assert "**e:**" not in text
