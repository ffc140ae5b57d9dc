"""Device telemetry: energy, summaries, health and idle strikes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom import banks
from chatloom.plans.blocks import previous, streaks


def power(df: DataFrame) -> DataFrame:
    """One ``power_w`` column for both sample shapes (the old one has only ``w``)."""
    if "w" not in df.columns:
        return df
    return df.withColumn("power_w", F.coalesce("power_w", "w") if "power_w" in df.columns else F.col("w")).drop("w")


def energy_wh(samples: DataFrame, run: Sequence[str], t: str, watts: str, block: Column | None = None) -> DataFrame:
    """Watt-hours per run by the trapezoid rule; null with fewer than two points.

    ``t`` is in seconds. Only steps forward in time add energy.
    """
    run = list(run)
    points = samples.where(F.col(t).isNotNull() & F.col(watts).isNotNull()).select(*run, t, watts)
    steps = previous(points, run, [t, watts], block, {"_t0": F.col(t), "_w0": F.col(watts)})
    dt = F.col(t) - F.col("_t0")
    joules = F.when(dt > 0, (F.col(watts) + F.col("_w0")) / 2 * dt).otherwise(F.lit(0.0))
    wh = F.when(F.count(F.lit(1)) >= 2, F.sum(joules) / 3600)
    return steps.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_points"), (F.max(t) - F.min(t)).alias("duration_s"), wh.alias("wh")
    )


def summary(samples: DataFrame, run: Sequence[str], t: str = "t", metrics: Sequence[str] = tuple(banks.TELEMETRY_METRICS)) -> DataFrame:
    """Average, peak and minimum of each metric, span, limit and throttle flag; unknown stays null."""
    have = [m for m in metrics if m in samples.columns]
    aggs = [F.count(t).alias("n_samples"), (F.max(t) - F.min(t)).alias("duration_s")]
    for m in have:
        for name, fn in (("avg", F.avg), ("peak", F.max), ("min", F.min)):
            aggs.append(F.round(fn(m), 2).alias(f"{m}_{name}"))
    if "power_limit_w" in samples.columns:
        aggs.append(F.round(F.max("power_limit_w"), 1).alias("power_limit_w"))
    if "temp_c" in have:
        aggs.append((F.max("temp_c") >= banks.THROTTLE_TEMP_C).alias("throttled"))
    return samples.groupBy(*run).agg(*aggs).where("n_samples > 0")


def health_codes(c: dict[str, Column]) -> Column:
    """Array of codes of one sample.

    ``c``: host_up, gpu_available, model_loaded, on_gpu, running, mem_frac,
    util_pct, idle_strikes, n_log_errors.
    """
    loaded, gpu = c["model_loaded"], c["gpu_available"]
    idle = c["running"] & loaded & c["on_gpu"] & (c["util_pct"] < 1.0) & (c["idle_strikes"] >= 2)
    rules = [
        ("HOST_DOWN", ~c["host_up"]),
        ("NO_NVIDIA_SMI", ~gpu),
        ("CPU_SPILL", loaded & ~c["on_gpu"]),
        ("MODEL_NOT_LOADED", ~loaded & c["running"]),
        ("VRAM_FULL", gpu & (c["mem_frac"] > 0.97)),
        ("GPU_IDLE", gpu & idle),
        ("LOG_ERRORS", c["n_log_errors"] > 0),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def health_status(codes: Column) -> Column:
    has = lambda names: F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))
    return F.when(has(banks.FATAL_CODES), F.lit("FATAL")).when(has(banks.WARN_CODES), F.lit("WARN")).otherwise(F.lit("OK"))


def worst_status(status: Column) -> Column:
    """Worst status of a group (an aggregate)."""
    level = F.when(status == "FATAL", 2).when(status == "WARN", 1).otherwise(0)
    return F.element_at(F.array(F.lit("OK"), F.lit("WARN"), F.lit("FATAL")), (F.max(level) + 1).cast("int"))


def strikes(samples: DataFrame, run: Sequence[str], order: Sequence[str], idle: Column, block: Column | None = None) -> DataFrame:
    """Consecutive idle samples up to each sample (0 on a busy one)."""
    return streaks(samples, run, order, block, idle, "strikes")


def log_errors(lines: DataFrame, by: str, line_no: str, line: str, tail: int = 8) -> DataFrame:
    """The last ``tail`` lines of each log that contain an error word.

    Only candidate lines reach the per-log ranking, which keeps at most ``tail``
    per task before the shuffle.
    """
    from pyspark.sql import Window

    low = F.lower(F.col(line))
    hit = F.exists(F.array(*[F.lit(w) for w in banks.LOG_ERROR_WORDS]), lambda w: F.contains(low, w))
    last = Window.partitionBy(by).orderBy(F.desc(line_no))
    return (
        lines.where(hit)
        .withColumn("back", F.row_number().over(last))
        .where(F.col("back") <= tail)
        .select(by, line_no, F.substring(F.trim(line), 1, 200).alias(line))
    )


def device_board(generation: DataFrame, embedding: DataFrame) -> DataFrame:
    """Device rows of both benchmark kinds in common columns; runs without telemetry stay null.

    Both sides: label, the summary columns they have, and ``per_item`` (energy per
    item or per thousand chunks).
    """
    cols = {
        "avg_w": "power_w_avg", "peak_w": "power_w_peak", "peak_temp_c": "temp_c_peak", "avg_util_pct": "util_gpu_pct_avg",
        "peak_vram_mib": "mem_used_mib_peak", "peak_clock_mhz": "clock_sm_mhz_peak", "energy_wh": "energy_wh",
    }

    def side(df: DataFrame, kind: str, unit: str) -> DataFrame:
        seen = F.col("available") if "available" in df.columns else F.lit(True)
        have = [
            (F.when(seen, F.col(src).cast("double")) if src in df.columns else F.lit(None).cast("double")).alias(dst)
            for dst, src in cols.items()
        ]
        hot = F.when(seen, F.col("throttled")) if "throttled" in df.columns else F.lit(None).cast("boolean")
        return df.select(
            F.lit(kind).alias("workload"), "label", *have, F.col("per_item").cast("double").alias("per_item"),
            F.lit(unit).alias("per_item_label"), hot.alias("throttled"),
        )

    return side(generation, "gen", "Wh/item").unionByName(side(embedding, "embed", "Wh/1k"))
