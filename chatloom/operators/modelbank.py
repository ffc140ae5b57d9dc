"""The model bank: merged entries, plans, benchmarks and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.banks import PROVIDER_ORDER


def provider_rank(provider: Column) -> Column:
    out = F.lit(99)
    for name, at in PROVIDER_ORDER.items():
        out = F.when(provider == name, F.lit(at)).otherwise(out)
    return out


def merge(static: DataFrame, local: DataFrame, discovered: DataFrame) -> DataFrame:
    """One entry per (provider, name): local overrides static, discovered only adds."""
    sides = [(local, 0), (static, 1), (discovered, 2)]
    rows = None
    for df, rank in sides:
        part = df.withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("provider", "name", "_rank")]
    named = rows.where((F.trim("name") != "") & (F.trim("provider") != ""))
    best = named.groupBy("provider", "name").agg(F.min_by(F.struct(*rest), "_rank").alias("r"))
    return best.select("provider", "name", *[F.col(f"r.{c}").alias(c) for c in rest])


def with_sidecars(entries: DataFrame, plans: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Entries with their plan and benchmark row, where there is one."""
    key = F.concat_ws(":", "provider", "name")
    return (
        entries.withColumn("model_key", key)
        .join(benchmarks, "model_key", "left")
        .join(plans, "plan_id", "left")
    )


def resolve(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry of each wanted name; the provider order decides, ambiguity is counted."""
    found = names.select("name").distinct().join(entries, "name")
    order = Window.partitionBy("name").orderBy(provider_rank(F.col("provider")), "provider")
    n = found.groupBy("name").agg(F.count(F.lit(1)).alias("n_providers"))
    return found.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at").join(n, "name")
