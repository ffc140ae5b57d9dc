"""Streams over several small files end where the batch jobs end."""

import pytest
from pyspark.sql import functions as F

from chatloom.operators import ingest, telemetry
from chatloom.streaming import jobs

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events table as six files in time order."""
    folder = str(tmp_path_factory.mktemp("feed"))
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = rows.count()
    for i in range(6):
        part = rows.where((F.col("event_id") >= i * n // 6) & (F.col("event_id") < (i + 1) * n // 6))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def _run(stream, folder, mode, sink):
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def test_upsert_equals_batch(spark, feed, tmp_path):
    folder, rows = feed
    pick = lambda df: df.select("user_id", "event_id", F.col("value").alias("update_time"))
    stream = jobs.read_events(spark, folder, SCHEMA, per_trigger=1)
    _run(pick(stream), str(tmp_path), "append", jobs.upsert_sink(f"{tmp_path}/out", "user_id", "update_time", "event_id", buckets=4))
    got = jobs.read_store(spark, f"{tmp_path}/out").select("user_id", "event_id", "update_time")
    want = ingest.newest_wins(pick(rows), None, "user_id", "update_time", "event_id")
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()
    # A replayed batch leaves the store as it is.
    sink = jobs.upsert_sink(f"{tmp_path}/out", "user_id", "update_time", "event_id", buckets=4)
    last = spark.read.parquet(f"{tmp_path}/out").agg(F.max("_batch")).collect()[0][0]
    sink(pick(spark.read.parquet(folder)), last)
    assert jobs.read_store(spark, f"{tmp_path}/out").select(*want.columns).exceptAll(want).isEmpty()


def test_late_points_are_put_where_they_belong(spark, tmp_path):
    """Files out of time order, points of each spread over the whole time, and a replayed batch: energy and strikes are those of the batch form."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in (3, 0, 4, 1, 2):
        rows.where(F.col("event_id") % 5 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    points = lambda df: df.select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.col("value").alias("w"), (F.col("event_type") == "view").alias("idle"))
    stream = lambda: points(jobs.read_events(spark, str(tmp_path / "feed"), SCHEMA, per_trigger=1))
    energy, strikes = str(tmp_path / "e" / "out"), str(tmp_path / "s" / "out")
    _run(stream().drop("idle"), str(tmp_path / "e"), "append", jobs.energy_sink(energy, "user_id", 200_000.0))
    _run(stream().drop("w"), str(tmp_path / "s"), "append", jobs.strikes_sink(strikes, "user_id", 200_000.0))
    want = {r.user_id: (r.n_points, r.wh and round(r.wh, 6)) for r in telemetry.energy_wh(points(rows), ["user_id"], "t", "w").collect()}
    read = lambda: {r.user_id: (r.n_points, r.wh and round(r.wh, 6)) for r in jobs.read_energy(spark, energy, "user_id").collect()}
    assert read() == want
    at_end = {}
    for r in points(rows).orderBy("t").collect():
        at_end[r.user_id] = at_end.get(r.user_id, 0) + 1 if r.idle else 0
    assert {r.user_id: r.strikes for r in jobs.read_strikes(spark, strikes, "user_id").collect()} == at_end
    store = spark.read.parquet(f"{energy}/points")
    assert store.groupBy("_bucket").agg(F.count_distinct("_batch").alias("n")).agg(F.max("n")).first()[0] <= 2
    # The last batch once more, as after a lost driver.
    file = max((tmp_path / "feed").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    jobs.energy_sink(energy, "user_id", 200_000.0)(points(spark.read.schema(SCHEMA).parquet(str(file))).drop("idle"), store.agg(F.max("_batch")).first()[0])
    assert read() == want


def test_distinct_and_windows(spark, feed, tmp_path):
    folder, rows = feed
    stream = jobs.read_events(spark, folder, SCHEMA, per_trigger=2).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = stream.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2))))
    ids = []
    _run(jobs.distinct_events(twice, "ts", ["event_id"], "1 hour").select("event_id"), f"{tmp_path}/d", "append", lambda b, _: ids.extend(r[0] for r in b.collect()))
    assert sorted(ids) == sorted(r.event_id for r in rows.select("event_id").collect())
    out = {}
    _run(jobs.windowed(stream, "ts", [], "1 hour", "1 day"), f"{tmp_path}/w", "append", lambda b, _: out.update({str(r.start): r.n for r in b.collect()}))
    want = {str(r.w.start): r["count"] for r in rows.groupBy(F.window("ts", "1 day").alias("w")).count().collect()}
    assert set(want) - set(out) <= {max(want), sorted(want)[-2]} and all(want[k] == v for k, v in out.items())


def test_many_stretches_take_few_folders_and_files(spark, tmp_path):
    """A batch of many tasks over many stretches writes few folders, of few files, and late points still count."""
    rows = spark.range(4_000, numPartitions=8).select((F.col("id") % 7).alias("run"), F.pmod(F.col("id") * 1_237, F.lit(4_000)).alias("t")).withColumn("idle", F.col("t") % 40 > 3)
    sink = jobs.strikes_sink(f"{tmp_path}/out", "run", 20.0)
    for i in (1, 0):
        sink(rows.where(F.col("t") % 2 == i), i)
        for part in ("points", "segments"):
            folders = list((tmp_path / "out" / part).glob(f"_batch={i}/_bucket=*"))
            assert 0 < len(folders) <= 4_000 // 20 // 16 and sum(len(list(f.glob("*.parquet"))) for f in folders) <= len(folders) + 8
    sink(rows.where(F.col("t") % 2 == 0), 2)
    sink(rows.where(F.lit(False)), 3)
    want = {}
    for r in sorted(rows.where("t % 2 = 1").union(rows.where("t % 2 = 0")).collect(), key=lambda r: r.t):
        want[r.run] = want.get(r.run, 0) + 1 if r.idle else 0
    alone = str(tmp_path / "alone")
    jobs.strikes_sink(alone, "run", 20.0)(rows, 0)
    assert {r.run: r.strikes for r in jobs.read_strikes(spark, alone, "run").collect()} == want
