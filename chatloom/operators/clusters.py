"""Group conversations into projects: connected components over shared slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chatloom.plans.stars import components as star_components

MERGE_CAP = 12


def edges(primary: DataFrame, archive_rows: DataFrame, merge_cap: int = MERGE_CAP) -> DataFrame:
    """``(conv_id, slug)`` memberships that may merge conversations.

    Slugs of real version archives always merge. A primary slug merges only when
    an archive backs it or when at most ``merge_cap`` conversations share it, so a
    generic title cannot glue unrelated conversations together.
    """
    strong = archive_rows.where("is_version AND slug <> ''").select("conv_id", "slug").distinct()
    backed = strong.select("slug").distinct().withColumn("backed", F.lit(True))
    size = primary.groupBy("slug").agg(F.count(F.lit(1)).alias("size"))
    kept = (
        size.join(backed, "slug", "left")
        .where((F.col("size") >= 2) & (F.coalesce("backed", F.lit(False)) | (F.col("size") <= merge_cap)))
        .select("slug")
    )
    weak = primary.join(kept, "slug", "left_semi").select("conv_id", "slug")
    return strong.unionByName(weak).distinct()


def components(membership: DataFrame, member: str = "conv_id", group: str = "slug") -> DataFrame:
    """``(member, cluster_id)``: the smallest member reachable over shared groups.

    A group links its members to the smallest of them, so a group of n gives n - 1
    edges; the components of these edges are found by star contraction.
    """
    hub = membership.groupBy(group).agg(F.min(member).alias("b"), F.max(member).alias("_top")).where("b <> _top").select(group, "b")
    edges = membership.join(hub, group).where(F.col(member) != F.col("b")).select(F.col(member).alias("a"), "b")
    labels = star_components(edges).select(F.col("node").alias(member), F.col("component").alias("cluster_id"))
    return (
        membership.select(member)
        .distinct()
        .join(labels, member, "left")
        .select(member, F.coalesce("cluster_id", member).alias("cluster_id"))
    )


def members(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Every conversation with its cluster; conversations without a link stand alone."""
    return heads.join(labels, "conv_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "conv_id"))


def canonical_slug(member_rows: DataFrame, primary: DataFrame) -> DataFrame:
    """Most common primary slug of a cluster; the earliest member decides ties."""
    votes = (
        member_rows.select("cluster_id", "conv_id", F.coalesce("create_time", F.lit(0.0)).alias("t"))
        .join(primary, "conv_id")
        .groupBy("cluster_id", "slug")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "conv_id")).alias("first"))
    )
    return votes.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "first", "slug"))["slug"].alias("slug")
    )


def cluster_archives(member_rows: DataFrame, archive_rows: DataFrame) -> DataFrame:
    """Archives of a cluster; the earliest member's spelling of a name is kept."""
    owned = member_rows.select("cluster_id", "conv_id", F.coalesce("create_time", F.lit(0.0)).alias("t"))
    first = F.struct("t", "conv_id", "turn_pos", "at", "filename", "slug", "version", "is_version")
    return (
        archive_rows.join(owned, "conv_id")
        .groupBy("cluster_id", "name_key")
        .agg(F.min(first).alias("z"))
        .select("cluster_id", "name_key", "z.filename", "z.slug", "z.version", "z.is_version")
    )


def cluster_files(member_rows: DataFrame, file_rows: DataFrame) -> DataFrame:
    return (
        file_rows.join(member_rows.select("conv_id", "cluster_id"), "conv_id")
        .select("cluster_id", "filename", "ext_class")
        .distinct()
    )


def merged_counts(member_rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Sum a per-conversation histogram ``(conv_id, name, n)`` over the cluster."""
    return (
        counts.join(member_rows.select("conv_id", "cluster_id"), "conv_id")
        .groupBy("cluster_id", name)
        .agg(F.sum("n").alias("n"))
    )


def top_keywords(member_rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most common title keywords of a cluster, first seen first on ties."""
    found = member_rows.select(
        "cluster_id",
        F.coalesce("create_time", F.lit(0.0)).alias("t"),
        "conv_id",
        F.posexplode("title_keywords").alias("at", "keyword"),
    )
    counted = found.groupBy("cluster_id", "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "conv_id", "at")).alias("first")
    )
    by_count = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= n).drop("first")


def latest_version(cluster_archive_rows: DataFrame, numeric: bool = True) -> DataFrame:
    """Version of the last release of a cluster.

    ``numeric`` orders 1.10 after 1.9; the textual order is kept as an option.
    """
    parts = F.transform(F.split(F.coalesce("version", F.lit("")), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))
    key = parts if numeric else F.coalesce("version", F.lit(""))
    return (
        cluster_archive_rows.where("is_version")
        .groupBy("cluster_id")
        .agg(F.max(F.struct(key.alias("k"), "filename", "version"))["version"].alias("version"))
    )


def roll_up(member_rows: DataFrame, slugs: DataFrame, cluster_archive_rows: DataFrame, cluster_file_rows: DataFrame) -> DataFrame:
    """One bounded fact row per cluster. ``member_rows`` are cards with ``cluster_id``."""
    facts = member_rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.min("create_date").alias("start_date"),
        F.max("create_date").alias("end_date"),
        *[F.sum(c).alias(c) for c in ("n_turns", "n_user_turns", "n_assistant_turns")],
        *[F.bool_or(c).alias(c) for c in ("has_code", "has_image_asset")],
    )
    arch = cluster_archive_rows.groupBy("cluster_id").agg(
        F.count_if("is_version").alias("n_versions"), F.count_if(~F.col("is_version")).alias("n_other_zips")
    )
    file = cluster_file_rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.count_if(F.col("ext_class") == c).alias(f"n_{c}") for c in ("code", "data")],
        *[
            F.bool_or(F.lower("filename").contains(s)).alias(flag)
            for flag, s in (("f_setup", "setup.py"), ("f_pyproject", "pyproject"), ("f_package", "package.json"),
                            ("f_skill", "skill.md"), ("f_json", ".json"), ("f_schema", "schema"), ("f_glossary", "glossary"))
        ],
    )
    out = facts.join(slugs, "cluster_id").join(arch, "cluster_id", "left").join(file, "cluster_id", "left")
    out = out.fillna(0, [c for c in out.columns if c.startswith("n_")])
    out = out.fillna(False, [c for c in out.columns if c.startswith("f_")])
    return out.withColumn("n_passes", F.col("n_versions"))
