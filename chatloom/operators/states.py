"""Coverage, gates, rubric scores and project states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom import banks


def coverage(ledger: DataFrame, by: Sequence[str] = (), unchanged_is_lost: bool = True) -> DataFrame:
    """Captured share of seen chats, scaled by parsed shards; null when nothing was seen.

    With ``unchanged_is_lost`` false, ``skipped`` (unchanged chats) does not count
    against the score and only the columns' ``lost`` does.
    """
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    names = ["seen", "skipped", "written", "shards_total", "shards_parsed"]
    sums = ledger.groupBy(*by).agg(*[total(c) for c in names + ([] if unchanged_is_lost else ["lost"])])
    gone = F.col("skipped") if unchanged_is_lost else F.col("lost")
    share = F.bround(100.0 * F.greatest(F.col("seen") - gone, F.lit(0)) / F.col("seen"), 1)
    short = (F.col("shards_total") > 0) & (F.col("shards_parsed") < F.col("shards_total"))
    scaled = F.when(short, F.bround(share * F.col("shards_parsed") / F.col("shards_total"), 1)).otherwise(share)
    return sums.withColumn("coverage", F.when(F.col("seen") > 0, scaled))


def privacy_gate(model: Column, scrubbed: Column, hits: Column) -> Column:
    """Local models pass; remote ones need evidence that scrubbing ran."""
    provider = F.lower(F.element_at(F.split(F.coalesce(model, F.lit("")), ":"), 1))
    return (
        F.when(provider == "", F.lit("unknown"))
        .when(provider.isin(banks.LOCAL_PROVIDERS), F.lit("pass"))
        .when(scrubbed.isNull() & hits.isNull(), F.lit("unknown"))
        .when(F.coalesce(scrubbed, F.lit(False)) & hits.isNotNull(), F.lit("pass"))
        .otherwise(F.lit("fail"))
    )


def coverage_gate(cov: Column, skipped: Column, total: Column, parsed: Column) -> Column:
    lost = F.coalesce(parsed < total, F.lit(False))
    return F.when(cov.isNull(), F.lit("unknown")).when((F.coalesce(skipped, F.lit(0)) > 0) | lost, F.lit("fail")).otherwise(F.lit("pass"))


def schema_gate(schema_valid_pct: Column) -> Column:
    return F.when(schema_valid_pct.isNull(), F.lit("unknown")).when(schema_valid_pct >= 100, F.lit("pass")).otherwise(F.lit("cap_50"))


def rubric_score(
    attainments: DataFrame, axes: Mapping[str, float], gates: DataFrame, by: Sequence[str], unknown: str = "exclude_and_report"
) -> DataFrame:
    """Weighted score per group with gates applied after the sum.

    ``attainments``: by, coordinate, attainment. ``axes``: coordinate -> weight.
    ``gates``: by, gate, effect, passed. Unknown axes are left out, count as zero
    (``fail_closed``) or make the score indeterminate (``indeterminate_if_material``).
    """
    by = list(by)
    groups = attainments.select(*by).distinct()
    # Every group meets every axis of the rubric: the axes ride along as one small array.
    bank = [F.struct(F.lit(c).alias("coordinate"), F.lit(float(w)).alias("weight")) for c, w in axes.items()]
    wanted = groups.withColumn("a", F.explode(F.array(*bank))).select(*by, "a.*")
    best = attainments.groupBy(*by, "coordinate").agg(F.max("attainment").alias("attainment"))
    full = wanted.join(best, [*by, "coordinate"], "left")
    known = F.col("attainment").isNotNull()
    sums = full.groupBy(*by).agg(
        F.bround(F.sum(F.coalesce("attainment", F.lit(0.0)) * F.col("weight") / 100.0), 3).alias("base_score"),
        F.sum(F.when(known, F.col("weight")).otherwise(F.lit(0.0) if unknown != "fail_closed" else F.col("weight"))).alias("used_weight"),
        F.count_if(~known).alias("n_excluded"),
    )
    cap = F.lit(None).cast("double")
    for name, limit in banks.GATE_CAPS.items():
        cap = F.when(F.col("effect") == name, F.lit(limit)).otherwise(cap)
    broken = gates.where(~F.col("passed"))
    effects = broken.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_failed_gates"),
        F.bool_or(F.col("effect") == "fail").alias("_fail"),
        F.bool_or(F.col("effect") == "indeterminate").alias("_open"),
        F.min(cap).alias("_cap"),
    )
    out = sums.join(effects, by, "left")
    failed = F.coalesce("_fail", F.lit(False))
    unclear = F.coalesce("_open", F.lit(False))
    if unknown == "indeterminate_if_material":
        unclear = unclear | (F.col("n_excluded") > 0)
        out = out.withColumn("base_score", F.when(F.col("n_excluded") == 0, F.col("base_score")))
    gated = F.when(failed, F.lit(0.0)).otherwise(F.least(F.col("base_score"), F.coalesce("_cap", F.col("base_score"))))
    return out.select(
        *by,
        "base_score",
        F.when(~unclear, F.bround(gated, 3)).alias("score"),
        F.when(unclear, F.lit("indeterminate")).when(failed, F.lit("failed")).otherwise(F.lit("scored")).alias("status"),
        "used_weight",
        "n_excluded",
        F.coalesce("n_failed_gates", F.lit(0)).alias("n_failed_gates"),
    )


def coordinates(rows: DataFrame, ids: Sequence[str], measured: Mapping[str, str], native: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Wide metric rows as long coordinate values with status and confidence.

    ``measured``: coordinate -> percent column (the attainment). ``native``:
    coordinate -> (metric column, unit), recorded without an attainment.
    """
    def entry(coord: str, att: Column, value: Column, metric: str, unit: str) -> Column:
        known = value.isNotNull()
        return F.struct(
            F.lit(coord).alias("coordinate"),
            att.cast("double").alias("attainment"),
            F.when(known, F.lit("measured")).otherwise(F.lit("unknown")).alias("status"),
            F.when(known, F.lit(metric)).alias("metric"),
            value.cast("double").alias("value"),
            F.when(known, F.lit(unit)).alias("unit"),
            F.when(known, F.lit(0.7)).otherwise(F.lit(0.0)).alias("confidence"),
        )

    out = [entry(c, F.col(col), F.col(col), col, "percent") for c, col in measured.items()]
    out += [entry(c, F.lit(None), F.col(col), col, unit) for c, (col, unit) in (native or {}).items()]
    return rows.select(*ids, F.explode(F.array(*out)).alias("x")).select(*ids, "x.*")


def flatten(states: DataFrame) -> DataFrame:
    """Long coordinates of nested state documents (``vector_states`` of ``coordinate_values``)."""
    rest = [c for c in states.columns if c != "vector_states"]
    return (
        states.select(*rest, F.explode("vector_states").alias("v"))
        .select(*rest, "v.vector_ref", F.explode("v.coordinate_values").alias("c"))
        .select(
            *rest, "vector_ref", F.col("c.coordinate_ref").alias("coordinate"),
            F.col("c.attainment_0_100").alias("attainment"), F.col("c.measurement_status").alias("status"),
            F.col("c.native_observations").alias("native"),
        )
        .where("coordinate IS NOT NULL")
    )


def sweep_report(long: DataFrame, coords: Sequence[str], value: str = "attainment") -> DataFrame:
    """One row per (workload, model); workloads are never averaged together."""
    return long.groupBy("workload", "model").pivot("coordinate", list(coords)).agg(F.max(value))


def state_name(file_name: Column) -> tuple[Column, Column]:
    """(workload, model) from a state file name ``workload__model.json``."""
    stem = F.regexp_replace(file_name, r"\.json$", "")
    parts = F.split(stem, "__", 2)
    two = F.size(parts) == 2
    return F.when(two, parts[0]).otherwise(F.lit("")), F.when(two, F.get(parts, F.lit(1))).otherwise(stem)


def undeclared_columns(columns: Mapping[str, str], declared: DataFrame) -> DataFrame:
    """Metric columns whose coordinate nobody declared; an empty declaration checks nothing."""
    spark = declared.sparkSession
    used = spark.createDataFrame(list(columns.items()), "column string, coordinate string")
    return used.join(declared.select("coordinate").distinct(), "coordinate", "left_anti").where(
        F.lit(not declared.isEmpty())
    )
