"""Writers: run-scoped tables, bundle texts, the chunk index and public documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatloom.functions import text as T
from chatloom.operators.bundles import bundle_index


def _write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def run_table(df: DataFrame, root: str, name: str, run: str) -> None:
    """A table of one run, as its partition of the shared table."""
    _write_partitions(df.withColumn("run_label", F.lit(run)), f"{root}/{name}", "run_label")


def read_run_table(spark: SparkSession, root: str, name: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").where(F.col("run_label") == run).drop("run_label")


def register_run(spark: SparkSession, root: str, run: str, updated: str) -> None:
    spark.createDataFrame([(run, updated)], "label string, updated string").write.mode("append").parquet(f"{root}/_runs")


def resolve_run(spark: SparkSession, root: str, run: str) -> str:
    """A run label, with ``latest`` resolved to the most recently registered run."""
    if run != "latest":
        return run
    newest = spark.read.parquet(f"{root}/_runs").orderBy(F.desc("updated"), F.desc("label")).limit(1).collect()
    if not newest:
        raise LookupError("no run is registered")
    return newest[0]["label"]


def bundle_texts(parts: DataFrame, root: str) -> None:
    """Bundle texts as one table and their index; stale bundles go away.

    Texts are a column, not a file each, as millions of folders would stall the commit.
    """
    out = parts.select("cluster_id", "part_no", "text")
    out.repartitionByRange("cluster_id", "part_no").sortWithinPartitions("cluster_id", "part_no").write.mode("overwrite").parquet(f"{root}/texts")
    bundle_index(parts).write.mode("overwrite").parquet(f"{root}/index")


def export_texts(spark: SparkSession, table: str, key: str, wanted: list[str], text: str, out: str) -> None:
    """Single text files of a few named rows of a table of texts, a folder per key (and part)."""
    rows = spark.read.parquet(table).where(F.col(key).isin(wanted))
    folders = [c for c in (key, "part_no") if c in rows.columns]
    rows.select(*folders, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*folders).option("lineSep", "\n").text(out)


def index(chunks: DataFrame, root: str, schema_tag: str) -> str:
    """Write a chunk index as a new generation and then point ``CURRENT`` at it.

    Readers follow the pointer, so they see the old or the new index, never half
    of one. Returns the path of the generation.
    """
    spark = chunks.sparkSession
    path = f"{root}/gen-{uuid.uuid4().hex}"
    chunks.withColumn("schema_tag", F.lit(schema_tag)).write.mode("errorifexists").parquet(path)
    stamp = spark.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("written"))
    stamp.write.mode("append").parquet(f"{root}/CURRENT")
    return path


def current_index(spark: SparkSession, root: str, schema_tag: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    from chatloom.sources import tables

    try:
        rows = spark.read.parquet(f"{root}/CURRENT").orderBy(F.desc("written")).limit(1).collect()
    except AnalysisException:
        return None
    return tables.index(spark, rows[0]["path"], schema_tag) if rows else None


def states(df: DataFrame, path: str) -> None:
    """Project states, one partition per workload and model."""
    _write_partitions(df, path, "workload", "model")


def public_documents(items: DataFrame, path: str) -> None:
    """Public items as JSON lines, and their markdown pages as one table (see ``export_texts``)."""
    items.write.mode("overwrite").json(f"{path}/items")
    items.select("slug", markdown().alias("page")).write.mode("overwrite").parquet(f"{path}/markdown")


def _section(title: str, lines: Column) -> Column:
    body = F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(F.size(lines) > 0, body)


def markdown() -> Column:
    """Readable page of an item row (flattened item columns)."""
    c = F.col
    blank = F.lit("")
    some = lambda x, otherwise: F.coalesce(F.nullif(x, blank), F.lit(otherwise))
    rationale = F.coalesce(F.concat(F.lit(" — "), F.nullif(c("archetype_rationale"), blank)), blank)
    domain = F.concat(some(c("domain"), "?"), F.coalesce(F.concat(F.lit(" / "), F.nullif(c("subdomain"), blank)), blank))
    dated = F.when(
        c("start_date").isNotNull() | c("end_date").isNotNull(),
        F.concat(F.lit("**Dates:** "), some(c("start_date"), "?"), F.lit(" → "), some(c("end_date"), "?")),
    )
    second = F.transform("secondary_archetypes", lambda a: F.concat(F.lit("`"), a["id"], F.lit("`")))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), some(c("title"), "unknown")),
        F.lit(""),
        F.concat(F.lit("**Slug:** `"), c("slug"), F.lit("`")),
        F.concat(F.lit("**Primary archetype:** `"), some(c("archetype"), "?"), F.lit("`"), rationale),
        F.concat(F.lit("**Primary domain:** `"), domain, F.lit("`")),
        F.concat(F.lit("**Durable project:** "), F.when(c("is_durable_project"), "yes").otherwise("no (one-off)")),
        F.when(F.size(second) > 0, F.concat(F.lit("**Secondary archetypes:** "), F.array_join(second, ", "))),
        dated,
        F.concat(F.lit("**Passes/versions:** "), c("n_passes"), F.lit(" ("), c("n_conversations"), F.lit(" conversations)")),
        F.lit(""),
        F.concat(F.lit("## Goal\n\n"), some(c("goal"), "_Not set._"), F.lit("\n")),
    )
    role = lambda o: F.coalesce(F.concat(F.lit(" _("), F.nullif(o["role"], blank), F.lit(")_")), blank)
    objectives = F.transform("objectives", lambda o: F.concat(F.lit("- "), o["text"], role(o)))
    entries = F.filter(F.map_entries("archetype_fields"), lambda e: ~F.coalesce(T.strip(e["value"]), blank).isin("", "[]"))
    listed = lambda v: F.array_join(
        F.transform(F.from_json(v, "array<string>"), lambda x: F.concat(F.lit("\n  - "), x)), ""
    )
    fields = F.transform(
        entries,
        lambda e: F.concat(
            F.lit("- **"), e["key"], F.lit(":**"),
            F.when(e["value"].startswith("["), listed(e["value"])).otherwise(F.concat(F.lit(" "), e["value"])),
        ),
    )
    changes = F.transform(
        "requirements_evolution",
        lambda r: F.concat(F.lit("- **"), some(r["date"], "?"), F.lit(":** "), F.coalesce(r["change"], blank)),
    )
    version = lambda z: F.coalesce(F.concat(F.lit(" (v"), F.nullif(z["version"], blank), F.lit(")")), blank)
    zips = F.transform("version_zip_files", lambda z: F.concat(F.lit("- `"), z["filename"], F.lit("`"), version(z)))
    return F.concat_ws(
        "\n", head, _section("Objectives", objectives), _section("Archetype fields", fields),
        _section("Requirements evolution", changes), _section("Version archives", zips),
    )
