"""Per-conversation facts. Repeated facts stay long tables, so no card grows without bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions import text as T
from chatloom.operators.conversations import BROWSING_TYPES, KNOWN_CONTENT_TYPES, REASONING_TYPES


def _n(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def signals(turn_rows: DataFrame) -> DataFrame:
    """Role counts and flags per conversation, in one map-side combined aggregate."""
    role, kind, text = F.col("role"), F.col("content_type"), F.col("text")
    return turn_rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        _n(role == "user").alias("n_user_turns"),
        _n(role == "assistant").alias("n_assistant_turns"),
        _n(role == "tool").alias("n_tool_turns"),
        F.bool_or((kind == "code") | text.contains("```")).alias("has_code"),
        F.bool_or(
            text.contains("[image]") | text.contains("[asset]") | F.lower(text).contains("[dalle")
        ).alias("has_image_asset"),
        F.bool_or(kind.isin(BROWSING_TYPES)).alias("has_browsing"),
        F.bool_or(kind.isin(REASONING_TYPES)).alias("has_reasoning"),
        F.bool_or(kind == "execution_output").alias("has_execution_output"),
    )


def content_types(turn_rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("content_type") == "", F.lit("text")).otherwise(F.col("content_type"))
    return turn_rows.groupBy("conv_id", kind.alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


def unknown_content_types(turn_rows: DataFrame) -> DataFrame:
    """Coverage audit: content types that only got a placeholder."""
    kind = F.col("content_type")
    return (
        turn_rows.where((kind != "") & ~kind.isin(KNOWN_CONTENT_TYPES))
        .groupBy("content_type")
        .agg(F.count(F.lit(1)).alias("n_turns"))
    )


def archives(turn_rows: DataFrame) -> DataFrame:
    """Archive names mentioned in a conversation; the first spelling of a name is kept."""
    found = turn_rows.select(
        "conv_id",
        F.col("pos").alias("turn_pos"),
        F.posexplode(F.regexp_extract_all("text", F.lit(T.ARCHIVE_NAME), F.lit(0))).alias("at", "filename"),
    )
    first = found.groupBy("conv_id", F.lower("filename").alias("name_key")).agg(
        F.min(F.struct("turn_pos", "at", "filename")).alias("first")
    )
    name = F.col("first.filename")
    return first.select(
        "conv_id",
        "name_key",
        F.col("first.turn_pos").alias("turn_pos"),
        F.col("first.at").alias("at"),
        name.alias("filename"),
        T.archive_slug(name).alias("slug"),
        T.archive_version(name).alias("version"),
        T.is_version_archive(name).alias("is_version"),
    )


def files(turn_rows: DataFrame) -> DataFrame:
    """Distinct file names mentioned in a conversation, with their class."""
    return (
        turn_rows.select(
            "conv_id", F.explode(F.regexp_extract_all("text", F.lit(T.FILE_NAME), F.lit(0))).alias("filename")
        )
        .distinct()
        .withColumn("ext_class", T.extension_class(F.col("filename")))
    )


def file_classes(file_rows: DataFrame) -> DataFrame:
    return file_rows.groupBy("conv_id", "ext_class").agg(F.count(F.lit(1)).alias("n"))


def attachments(message_rows: DataFrame) -> DataFrame:
    return message_rows.select("conv_id", F.explode("attachments").alias("name")).distinct()


def model_votes(message_rows: DataFrame) -> DataFrame:
    return (
        message_rows.where("model IS NOT NULL").groupBy("conv_id", "model").agg(F.count(F.lit(1)).alias("votes"))
    )


def slug_votes(archive_rows: DataFrame, heads: DataFrame) -> DataFrame:
    """+3 per real version archive, +1 for the title slug; ``seen`` orders equal votes."""
    strong = archive_rows.where("is_version AND slug <> ''").select(
        "conv_id", "slug", F.lit(3).alias("w"), F.struct(F.lit(0).alias("src"), "turn_pos", "at").alias("seen")
    )
    weak = heads.select(
        "conv_id",
        T.kebab(F.col("title")).alias("slug"),
        F.lit(1).alias("w"),
        F.struct(
            F.lit(1).alias("src"), F.lit(0).cast("bigint").alias("turn_pos"), F.lit(0).alias("at")
        ).alias("seen"),
    ).where("slug <> ''")
    return (
        strong.unionByName(weak)
        .groupBy("conv_id", "slug")
        .agg(F.sum("w").alias("votes"), F.min("seen").alias("seen"))
    )


def primary_slug(heads: DataFrame, votes: DataFrame) -> DataFrame:
    """Strongest slug of each conversation (first seen on equal votes), else a name of its own."""
    # The smallest (-votes, seen) is the strongest vote, earliest first.
    best = votes.groupBy("conv_id").agg(
        F.min(F.struct((-F.col("votes")).alias("neg"), "seen", "slug"))["slug"].alias("slug")
    )
    own = F.concat(F.lit("unclustered-"), F.substring("conv_id", 1, 8))
    return heads.select("conv_id").join(best, "conv_id", "left").select(
        "conv_id", F.coalesce("slug", own).alias("slug")
    )


def cards(heads: DataFrame, turn_rows: DataFrame, archive_rows: DataFrame, file_rows: DataFrame) -> DataFrame:
    """One bounded row per conversation."""
    n_arch = archive_rows.groupBy("conv_id").agg(F.count_if("is_version").alias("n_version_zips"))
    n_file = file_rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_file_artifacts"))
    wide = (
        heads.drop("mapping", "current_node")
        .join(signals(turn_rows), "conv_id", "left")
        .join(n_arch, "conv_id", "left")
        .join(n_file, "conv_id", "left")
        .withColumn("title_keywords", T.title_keywords(F.col("title")))
    )
    zero = [c for c, t in wide.dtypes if c.startswith("n_")]
    flag = [c for c, t in wide.dtypes if c.startswith("has_")]
    return wide.fillna(0, zero).fillna(False, flag)


# --- legacy records -------------------------------------------------------


def from_legacy(projects: DataFrame, priors: DataFrame) -> DataFrame:
    """Old flat project records in the item shape, classified by the rule prior.

    ``projects`` keeps objectives and evolution as JSON elements, since old runs
    wrote plain texts where newer ones wrote objects.
    """
    as_objective = lambda o: F.coalesce(F.get_json_object(o, "$.text"), F.when(~o.startswith("{"), T.nonblank(o)))
    as_change = lambda o: F.struct(
        F.get_json_object(o, "$.date").alias("date"),
        F.coalesce(F.get_json_object(o, "$.change"), F.when(~o.startswith("{"), T.nonblank(o))).alias("change"),
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = F.create_map(
        *[x for k in ("quickstart", "how_to_use", "how_to_update", "use_case") for x in (F.lit(k), text(k))]
    )
    return projects.join(priors.select("slug", "archetype", "domain", "subdomain"), "slug", "left").select(
        "slug",
        F.coalesce("project_name", "slug").alias("title"),
        text("description").alias("description"),
        text("goal").alias("goal"),
        (F.coalesce("n_versions", F.lit(0)) >= 1).alias("is_durable_project"),
        F.filter(F.transform("objectives", as_objective), lambda x: x.isNotNull()).alias("objectives"),
        F.filter(F.transform("requirements", T.nonblank), lambda x: x.isNotNull()).alias("requirements"),
        F.filter(F.transform("requirements_evolution", as_change), lambda x: x["change"].isNotNull()).alias(
            "requirements_evolution"
        ),
        fields.alias("archetype_fields"),
        "archetype",
        "domain",
        "subdomain",
        F.lit(0.0).alias("confidence"),
        F.lit("deterministic_prior").alias("classification_source"),
    )
