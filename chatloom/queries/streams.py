"""Streaming forms over ``events``, run to the end of the given file and read back.

Each query writes to its own folder below the shared folder and returns the
table the stream left there, so nothing passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from chatloom.queries.base import Tables, query
from chatloom.session import shared_dir, tune
from chatloom.streaming import jobs

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t: Tables) -> DataFrame:
    tune(t.spark)
    rows = jobs.read_events(t.spark, t.sf_dir, _SCHEMA, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _run(stream: DataFrame, folder: str, mode: str, sink=None) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{folder}/out")
    running = writer.start()
    running.awaitTermination()


def _latest(folder: str):
    """Sink of an update stream: every batch is kept under its number, so a replay rewrites the same rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/_b={batch_id}")

    return write


def _last_per_key(t: Tables, folder: str, *keys: str) -> DataFrame:
    rows = t.spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/_b=*")
    rest = [c for c in rows.columns if c not in (*keys, "_b")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_b").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


@query(
    """SELECT user_id, event_id, value AS update_time FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1"""
)
def stream_newest_wins(t: Tables):
    """Streaming upsert: equal to the batch query ``newest_wins``."""
    folder = _folder(t, "upsert")
    rows = _events(t).select("user_id", "event_id", F.col("value").alias("update_time"))
    _run(rows, folder, "append", jobs.upsert_sink(f"{folder}/out", "user_id", "update_time", "event_id", buckets=8))
    return jobs.read_store(t.spark, f"{folder}/out")


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed,
      round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS secs FROM events GROUP BY 1"""
)
def stream_live_speed(t: Tables):
    """Running totals per model, last state of each."""
    folder = _folder(t, "speed")
    rows = _events(t).withColumn("secs", F.col("value"))
    _run(jobs.live_speed(rows, "user_id", "purchase", "error"), folder, "update", _latest(folder))
    return _last_per_key(t, folder, "user_id").withColumn("secs", F.round("secs", 2))


@query(
    """WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS w, lag(epoch_us(ts) / 1e6) OVER o AS t0, lag(value) OVER o AS w0 FROM events
      WINDOW o AS (PARTITION BY user_id ORDER BY ts, value))
    SELECT user_id, count(*) AS n_points, round(coalesce(sum(CASE WHEN t > t0 THEN (w + w0) / 2 * (t - t0) ELSE 0 END), 0) / 3600, 4) AS wh FROM p GROUP BY 1"""
)
def stream_energy(t: Tables):
    """Energy kept per run and day, a late point put where it belongs: equal to the batch query ``energy_wh``."""
    folder = _folder(t, "energy")
    points = _events(t).select("user_id", (F.unix_micros("ts") / F.lit(1e6)).alias("t"), F.col("value").alias("w"))
    _run(points, folder, "append", jobs.energy_sink(f"{folder}/out", "user_id", 86_400.0))
    return jobs.read_energy(t.spark, f"{folder}/out", "user_id").withColumn("wh", F.round(F.coalesce("wh", F.lit(0.0)), 4))


@query(
    """WITH z AS (SELECT user_id, ts, event_id, (event_type = 'view')::INT AS idle FROM events),
    l AS (SELECT user_id, max(event_id) FILTER (idle = 0) AS busy FROM z GROUP BY 1)
    SELECT user_id, count(*) FILTER (event_id > coalesce(busy, -1)) AS strikes FROM z JOIN l USING (user_id) GROUP BY 1"""
)
def stream_strikes(t: Tables):
    """Idle samples in a row at the end of each run."""
    folder = _folder(t, "strikes")
    rows = _events(t).select("user_id", F.col("event_id").alias("t"), (F.col("event_type") == "view").alias("idle"))
    _run(rows, folder, "append", jobs.strikes_sink(f"{folder}/out", "user_id", 2_048.0))
    return jobs.read_strikes(t.spark, f"{folder}/out", "user_id")


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, avg(round(value * 100)::BIGINT) AS avg_value, max(round(value * 100)::BIGINT) AS peak_value
    FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type"""
)
def stream_windows(t: Tables):
    """Hourly windows in update mode, in hundredths: closed and open ones, each as last seen."""
    folder = _folder(t, "windows")
    rows = _events(t).withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    _run(jobs.windowed(rows, "ts", ["event_type"], "1 hour", "1 hour"), folder, "update", _latest(folder))
    last = _last_per_key(t, folder, "start", "event_type")
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "avg_value", "peak_value")


@query(
    """WITH f AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM f)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def stream_sessions(t: Tables):
    """Activity sessions, closed and open, as the last complete output of a run to the end."""
    folder = _folder(t, "sessions")
    _run(jobs.sessions(_events(t), "ts", ["user_id"], "1 hour", "30 minutes"), folder, "complete", _latest(folder))
    rows = t.spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/_b=*")
    newest = rows.agg(F.max("_b").alias("_b"))
    last = rows.join(F.broadcast(newest), "_b", "left_semi")
    return last.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT DISTINCT event_id FROM events")
def stream_distinct(t: Tables):
    """Events delivered twice come out once."""
    folder = _folder(t, "distinct")
    twice = _events(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    _run(jobs.distinct_events(twice, "ts", ["event_id"], "1 hour").select("event_id"), folder, "append")
    return t.spark.read.parquet(f"{folder}/out")
