"""Structured Streaming forms of the ingest, speed and telemetry jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chatloom.operators.ingest import newest_wins


def read_events(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def upsert_sink(root: str, key: str, updated: str, order: str, buckets: int = 64):
    """``foreachBatch`` sink that keeps the newest row per key.

    The store is hash-partitioned into buckets, so a batch rewrites only the
    buckets its keys fall into. Each generation is written beside the one it
    replaces and named by its batch id, so a replayed batch gives the same store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("bigint")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        old = read_store(spark, root, upto=batch_id, only=touched)
        merged = newest_wins(batch, old, key, updated, order)
        _write_generation(merged.withColumn("_bucket", bucket), root, batch_id)
        drop_generations(spark, root, batch_id)

    return write


def _write_generation(rows: DataFrame, root: str, batch_id: int) -> None:
    """Write rows with their ``_bucket`` as the generation of a batch."""
    (
        rows.withColumn("_batch", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_bucket").parquet(root)
    )


def drop_generations(spark: SparkSession, root: str, batch_id: int) -> None:
    """Remove generations that no read and no replay of the last batch needs: all but the last two of each bucket."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held: dict[str, list[tuple[int, object]]] = {}
    for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/_batch=*/_bucket=*")) or []:
        batch = int(status.getPath().getParent().getName().split("=")[1])
        if batch <= batch_id:
            held.setdefault(status.getPath().getName(), []).append((batch, status.getPath()))
    for generations in held.values():
        for _, old in sorted(generations, key=lambda g: g[0])[:-2]:
            files.delete(old, True)


def read_store(
    spark: SparkSession, root: str, upto: int | None = None, only: Sequence[int] | None = None
) -> DataFrame | None:
    """Current rows of an upsert store: the last generation of every bucket.

    Generation and bucket are folders, so the filters on them choose folders.
    """
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(root)
    except AnalysisException:
        return None
    if upto is not None:
        rows = rows.where(F.col("_batch") < upto)
    if only is not None:
        rows = rows.where(F.col("_bucket").isin(list(only)))
    # One row per bucket, found from the folder names alone.
    last = rows.groupBy("_bucket").agg(F.max("_batch").alias("_batch"))
    return rows.join(F.broadcast(last), ["_bucket", "_batch"], "left_semi").drop("_batch", "_bucket")


def compact_store(spark: SparkSession, root: str, target: str, key: str, buckets: int = 64) -> None:
    """Copy the current rows of a store to a new root as its first generation."""
    rows = read_store(spark, root)
    if rows is None:
        raise LookupError(f"no store at {root}")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows.withColumn("_bucket", bucket).withColumn("_batch", F.lit(-1).cast("bigint")).write.mode("errorifexists").partitionBy(
        "_batch", "_bucket"
    ).parquet(target)


def live_speed(events: DataFrame, by: str, ok: str, fail: str) -> DataFrame:
    """Running totals per model, for ``update`` or ``complete`` mode."""
    good = F.col("event_type") == ok
    return events.groupBy(by).agg(
        F.count_if(good).alias("completed"),
        F.count_if(F.col("event_type") == fail).alias("failed"),
        F.sum(F.when(good, F.col("secs")).otherwise(0.0)).alias("secs"),
    )


def windowed(samples: DataFrame, ts: str, by: Sequence[str], late: str, size: str, slide: str | None = None, value: str = "value") -> DataFrame:
    """Tumbling or sliding averages with a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        samples.withWatermark(ts, late)
        .groupBy(w.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("peak_value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "avg_value", "peak_value")
    )


def sessions(events: DataFrame, ts: str, by: Sequence[str], late: str, gap: str) -> DataFrame:
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
    )


def distinct_events(events: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


# --- summaries of stretches of time ----------------------------------------


#: Stretches that share a folder: a store has so many times fewer folders and files than stretches.
STRETCHES = 32


def segment_sink(root: str, t: str, width: float, summary: Callable[[DataFrame], DataFrame]):
    """``foreachBatch`` sink that keeps points by stretches of ``width`` of ``t``, and one summary row per run and ``stretch``.

    A batch adds its points to the folders they fall into and sums up their stretches anew,
    so a point that comes late is put where it belongs, however late. Points are dealt out
    by folder and ``t`` before they are written, so each folder has few files whatever the
    number of tasks that read the batch, and a crowded one is still shared among tasks. Summaries of neighbouring
    stretches are put together when they are read. Generations are kept as in
    ``upsert_sink``: a replayed batch gives the same store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stretch = F.floor(F.col(t) / width).cast("bigint")
        bucket = F.floor(F.col("stretch") / STRETCHES).cast("bigint")
        rows = batch.withColumn("stretch", stretch).withColumn("_bucket", bucket)
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # folders that the batch has points in
        if not touched:
            return
        old = read_store(spark, f"{root}/points", upto=batch_id, only=touched)
        if old is not None:
            rows = rows.unionByName(old.withColumn("_bucket", bucket))
        _write_generation(rows.repartitionByRange("_bucket", t), f"{root}/points", batch_id)
        written = spark.read.parquet(f"{root}/points").where((F.col("_batch") == batch_id) & F.col("_bucket").isin(touched))
        summed = summary(written.drop("_batch", "_bucket")).withColumn("_bucket", bucket)
        _write_generation(summed.repartitionByRange("_bucket", "stretch"), f"{root}/segments", batch_id)
        drop_generations(spark, f"{root}/points", batch_id)
        drop_generations(spark, f"{root}/segments", batch_id)

    return write


def energy_sink(root: str, run: str, width: float = 3600.0):
    """Keeps the energy of every run and hour. Points: run, t (seconds), w."""

    def summary(points: DataFrame) -> DataFrame:
        before = Window.partitionBy(run, "stretch").orderBy("t", "w")
        dt = F.col("t") - F.lag("t").over(before)
        step = F.when(dt > 0, (F.col("w") + F.lag("w").over(before)) / 2 * dt).otherwise(0.0)
        point = F.struct("t", "w")
        return points.withColumn("_step", step).groupBy(run, "stretch").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_step").alias("joules"), F.min(point).alias("first"), F.max(point).alias("last"))

    return segment_sink(root, "t", width, summary)


def read_energy(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Energy per run so far: run, n_points, wh (null with fewer than two points). Adds the steps between stretches."""
    segments = _segments(spark, root)
    prior = F.lag("last").over(Window.partitionBy(run).orderBy("stretch"))
    dt = F.col("first.t") - F.col("prior.t")
    between = F.when(dt > 0, (F.col("first.w") + F.col("prior.w")) / 2 * dt).otherwise(0.0)
    n = F.sum("n")
    return segments.withColumn("prior", prior).groupBy(run).agg(
        n.alias("n_points"), F.when(n >= 2, F.sum(F.col("joules") + between) / 3600.0).alias("wh"))


def strikes_sink(root: str, run: str, width: float = 3600.0):
    """Keeps what the strikes of every run need of each stretch. Points: run, t, idle (boolean)."""

    def summary(points: DataFrame) -> DataFrame:
        busy = F.max(F.when(~F.col("idle"), F.col("t"))).over(Window.partitionBy(run, "stretch"))
        return points.withColumn("_busy", busy).groupBy(run, "stretch").agg(
            F.count(F.lit(1)).alias("n"), F.max("_busy").isNotNull().alias("busy"), F.count_if(F.col("t") > F.col("_busy")).alias("trailing"))

    return segment_sink(root, "t", width, summary)


def read_strikes(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Consecutive idle samples at the end of what was seen of each run: those after its last busy stretch, and those that end it."""
    last = F.max(F.when(F.col("busy"), F.col("stretch"))).over(Window.partitionBy(run))
    own = F.when(F.col("_last").isNull() | (F.col("stretch") > F.col("_last")), F.col("n")).when(F.col("stretch") == F.col("_last"), F.col("trailing"))
    return _segments(spark, root).withColumn("_last", last).groupBy(run).agg(F.coalesce(F.sum(own), F.lit(0)).alias("strikes"))


def _segments(spark: SparkSession, root: str) -> DataFrame:
    rows = read_store(spark, f"{root}/segments")
    if rows is None:
        raise LookupError(f"no summaries at {root}")
    return rows
