"""Readers of the catalog's own tables and of run outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatloom.operators.telemetry import power

TRACE = (
    "run_id string, sequence bigint, ts_utc string, severity string, event_type string, message string, "
    "payload struct<secs: double, in_tok: bigint, out_tok: bigint, usd: double, schema_valid: boolean, "
    "load_ms: double, eval_ms: double, prompt_eval_ms: double, error: string>"
)
SAMPLE = (
    "t double, w double, gpu_index int, gpu_name string, power_w double, power_limit_w double, temp_c double, "
    "util_gpu_pct double, util_mem_pct double, mem_used_mib double, mem_total_mib double, clock_sm_mhz double, "
    "clock_mem_mhz double, fan_pct double, pstate string"
)
CARD = (
    "id string, title string, create_date string, update_date string, create_time double, update_time double, "
    "source_zip string, n_turns bigint, attachments array<string>, file_artifacts array<string>, "
    "slug_votes map<string,bigint>, model_slug_votes map<string,bigint>, "
    "zip_files array<struct<filename: string, slug: string, version: string, is_version: boolean>>, "
    "signals struct<n_turns: bigint, n_user_turns: bigint, n_assistant_turns: bigint, n_tool_turns: bigint, "
    "content_types: map<string,bigint>, file_ext_classes: map<string,bigint>, has_code: boolean, "
    "has_image_asset: boolean, title_keywords: array<string>>"
)
_ITEM_OLD = (
    "slug string, project_name string, goal string, description string, objectives array<string>, "
    "requirements array<string>, quickstart string, how_to_use string, how_to_update string, use_case string"
)
_ITEM_NEW = (
    "slug string, title string, goal string, description string, llm_ok boolean, schema_valid boolean, "
    "classification_source string, is_durable_project boolean, n_passes bigint, "
    "primary_archetype struct<id: string, rationale: string>, "
    "primary_domain_pair struct<domain: string, subdomain: string>, objectives array<string>, requirements array<string>, "
    "archetype_fields map<string,string>, cognitive_type string, verifiability_class string, difficulty struct<tier: string>"
)

def _nested(fields: str) -> str:
    """``a int, b struct<x: int>`` as struct members ``a: int, b: struct<x: int>``."""
    out, depth, word = [], 0, ""
    for ch in fields + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += ch
    return ", ".join(out)


OUTPUT = (
    "generated_by string, provider string, model string, classification_source string, "
    f"items array<struct<{_nested(_ITEM_NEW)}>>, projects array<struct<{_nested(_ITEM_OLD)}>>"
)


def cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).json(path)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def traces(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Trace events of many files; unreadable lines are dropped, a file named twice is read once."""
    wanted = sorted({paths} if isinstance(paths, str) else set(paths))
    rows = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(wanted)
    return rows.select(
        F.coalesce("run_id", F.lit("?")).alias("run_id"), "sequence", "ts_utc", "severity", "event_type", "message",
        "payload", run_label(F.col("_metadata.file_path")).alias("run_label"),
    )


def telemetry(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    rows = spark.read.schema(SAMPLE).option("mode", "DROPMALFORMED").json(paths)
    return power(rows.select("*", run_label(F.col("_metadata.file_path")).alias("run_label")))


def run_label(path: Column) -> Column:
    """Label of the run folder a file lies in (``.../runs/<label>/file``)."""
    return F.nullif(F.regexp_extract(path, r"/runs/([^/]+)/[^/]*$", 1), F.lit(""))


def model_label(generated_by: Column, provider: Column, model: Column, fallback: Column) -> Column:
    named = F.when((generated_by != "") & (generated_by != "?"), F.element_at(F.split(generated_by, " "), 1))
    pair = F.when((provider != "") & (model != "") & (model != "*"), F.concat(provider, F.lit(":"), model))
    label = F.coalesce(named, pair, F.nullif(provider, F.lit("")), fallback)
    return F.regexp_replace(label, ":+$", "")


def outputs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Items of run outputs of both schema generations, in common columns."""
    docs = documents(spark, paths, OUTPUT).select("*", F.col("_metadata.file_path").alias("file"))
    base = [
        "file",
        model_label(F.col("generated_by"), F.col("provider"), F.col("model"), F.coalesce(run_label(F.col("file")), F.col("file"))).alias("model"),
        F.col("classification_source").alias("doc_source"),
    ]
    none = F.lit(None)
    new = docs.select(*base, F.posexplode("items").alias("pos", "i")).select(
        "file", "model", "doc_source", "pos", "i.slug", "i.goal", "i.description", "i.llm_ok", "i.schema_valid",
        "i.classification_source", F.nullif("i.primary_archetype.id", F.lit("")).alias("archetype"),
        F.nullif("i.primary_domain_pair.domain", F.lit("")).alias("domain"), "i.objectives", "i.requirements",
        "i.archetype_fields", "i.cognitive_type", "i.verifiability_class", F.col("i.difficulty.tier").alias("tier"),
        F.lit("items").alias("generation"),
    )
    keys = ("quickstart", "how_to_use", "how_to_update", "use_case")
    fields = F.create_map(*[x for k in keys for x in (F.lit(k), F.coalesce(f"p.{k}", F.lit("")))])
    old = docs.where("items IS NULL").select(*base, F.posexplode("projects").alias("pos", "p")).select(
        "file", "model", "doc_source", "pos", "p.slug", "p.goal", "p.description",
        none.cast("boolean").alias("llm_ok"), none.cast("boolean").alias("schema_valid"),
        F.lit("none").alias("classification_source"), none.cast("string").alias("archetype"), none.cast("string").alias("domain"),
        "p.objectives", "p.requirements", fields.alias("archetype_fields"), none.cast("string").alias("cognitive_type"),
        none.cast("string").alias("verifiability_class"), none.cast("string").alias("tier"), F.lit("projects").alias("generation"),
    )
    rows = new.unionByName(old)
    return rows.withColumn("slug", F.coalesce(F.nullif("slug", F.lit("")), F.concat(F.lit("_"), F.col("pos"))))


def battery(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions: id, question or query, grade, gold chats."""
    schema = (
        "id string, question string, query string, type string, expected string, gold_chat_ids array<string>, "
        "grade struct<type: string, needles: array<string>, expected: string>"
    )
    return spark.read.schema(schema).json(path).select(
        "id", F.coalesce("question", "query").alias("question"), "type", F.col("grade.type").alias("grade_type"),
        "grade.needles", F.coalesce("grade.expected", "expected").alias("expected"),
        F.coalesce("gold_chat_ids", F.array().cast("array<string>")).alias("gold_chat_ids"),
    )


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text logs: file, pos, line. ``pos`` orders the lines of a file.

    Files stay splittable: splits are ordered by where they start, lines inside a
    split by the order they are read in.
    """
    pos = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), pos.alias("pos"), F.col("value").alias("line"))


def index(spark: SparkSession, path: str, schema_tag: str) -> DataFrame | None:
    """A stored chunk index, or None when it is missing or of another format."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    if "schema_tag" not in rows.columns:
        return None
    rows = rows.where(F.col("schema_tag") == schema_tag)
    return None if rows.isEmpty() else rows.drop("schema_tag")


def run_labels(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """Labels of the runs that hold an artifact."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", artifact).load(root)
    )
    return listed.select(run_label(F.col("path")).alias("run_label")).where("run_label IS NOT NULL").distinct()
