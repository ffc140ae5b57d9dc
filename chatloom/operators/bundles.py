"""Budgeted text bundles: fair shares, truncation, first-N lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.plans.blocks import pack_text
from chatloom.session import cut

CHAR_BUDGET = 48_000
CUT_NOTE = "\n[...conversation truncated to fit bundle budget...]"
MAX_TITLES, MAX_FILES = 40, 60
PART_CHARS = 1_000_000


def select_clusters(
    clusters: DataFrame, min_versions: int = 1, multi_chat: bool = True, singletons: bool = False
) -> DataFrame:
    keep = F.coalesce("n_versions", F.lit(0)) >= min_versions
    if multi_chat:
        keep = keep | (F.coalesce("n_conversations", F.lit(0)) >= 2)
    return clusters if singletons else clusters.where(keep)


def fair_shares(members: DataFrame, keys: Sequence[str], need: str, budget: Column | str) -> DataFrame:
    """Water-filling: small members are kept whole and leave their surplus to larger ones.

    Adds ``alloc``. Members are taken by ascending need; one fits whole while its need is
    within the equal share of what is left, and the first that does not fit fixes the
    level for the rest. Members of one need all fit or none does, and those above the
    budget cannot, so a group comes down to counts of its needs, at most as many as its
    budget has characters, before anything is put in order: no group is too large.

    ``budget`` is a column of the group (the same value on all its members). A null need
    is none.
    """
    keys = list(keys)
    cap = F.greatest(F.col(budget) if isinstance(budget, str) else budget, F.lit(0)).cast("bigint")
    wanted = F.coalesce(F.col(need).cast("bigint"), F.lit(0))
    counts = members.select(*keys, cap.alias("_cap"), F.least(wanted, cap + 1).alias("_need")).groupBy(*keys, "_need").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_cap").alias("_cap"))
    group = Window.partitionBy(*keys)
    smaller = group.orderBy("_need").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_cap") - F.coalesce(F.sum(F.col("_need") * F.col("_n")).over(smaller), F.lit(0))
    heads = F.sum("_n").over(group) - F.coalesce(F.sum("_n").over(smaller), F.lit(0))
    shared = counts.select(*keys, "_need", "_cap", left.alias("_left"), heads.alias("_heads")).withColumn("_share", F.expr("_left div _heads"))
    misfit = (F.col("_need") > F.col("_share")) | (F.col("_share") <= 0) | (F.col("_need") > F.col("_cap"))
    # The smallest need that does not fit fixes the level of its group.
    first = F.min(F.struct("_need", F.greatest("_share", F.lit(0)).alias("level"))).alias("_first")
    levels = shared.where(misfit).groupBy(*keys).agg(first).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    alloc = F.when(wanted >= F.col("_first._need"), F.col("_first.level")).otherwise(wanted)
    return members.join(levels, same, "left").withColumn("alloc", alloc).drop("_first", *[f"_k_{k}" for k in keys])


def fit_text(header: Column, body: Column, alloc: Column, note: str = CUT_NOTE) -> Column:
    """Header and body when they fit, else the body cut to its share with a visible note."""
    room = F.greatest(alloc - F.length(header), F.lit(0)).cast("int")
    return F.when(F.length(header) + F.length(body) <= alloc, F.concat(header, body)).otherwise(
        F.concat(header, F.substring(body, F.lit(1), room), F.lit(note))
    )


def member_blocks(members: DataFrame, budget: Column | str = CHAR_BUDGET) -> DataFrame:
    """Packed text of each member in chronological order.

    ``members``: cluster_id, conv_id, create_time, create_date, title, text and,
    if named, a budget column. Members without a transcript are not there.
    """
    header = F.concat(
        F.lit("\n\n--- conversation "), F.col("conv_id"), F.lit(" | "), F.coalesce("create_date", F.lit("None")),
        F.lit(" | "), F.coalesce("title", F.lit("None")), F.lit(" ---\n"),
    )
    cap = F.lit(budget) if isinstance(budget, int) else budget
    ready = members.withColumn("header", header).withColumn("need", F.length("header") + F.length("text"))
    shared = fair_shares(ready, ["cluster_id"], "need", cap)
    return shared.select(
        "cluster_id",
        F.coalesce("create_time", F.lit(0.0)).alias("create_time"),
        "conv_id",
        fit_text(F.col("header"), F.col("text"), F.col("alloc")).alias("block"),
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, n: int, note: bool = True) -> DataFrame:
    """The first ``n`` values per key in order, then a ``...(+k more)`` entry, as one bounded array."""
    w = Window.partitionBy(*keys).orderBy(*order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heads = (
        df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias("v")))).alias("_h"))
    )
    values = F.transform("_h", lambda x: x["v"])
    more = F.concat(F.lit("...(+"), (F.col("_n") - n).cast("string"), F.lit(" more)"))
    full = F.when(F.col("_n") > n, F.concat(values, F.array(more))).otherwise(values) if note else values
    return heads.join(counts, list(keys)).select(*keys, full.alias(value), F.col("_n").alias("n_total"))


def facts_text(clusters: DataFrame, titles: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """The leading fact section of each bundle, as text, and the budget it leaves."""
    facts = (
        clusters.join(titles.select("cluster_id", F.col("title").alias("titles")), "cluster_id", "left")
        .join(files.select("cluster_id", F.col("filename").alias("file_artifacts")), "cluster_id", "left")
        .join(versions.select("cluster_id", F.col("filename").alias("version_zip_files")), "cluster_id", "left")
    )
    body = F.to_json(
        F.struct("slug", "start_date", "end_date", "n_conversations", "n_versions", "version_zip_files", "file_artifacts", "titles"),
        {"ignoreNullFields": "false", "pretty": "true"},
    )
    text = F.concat(
        F.lit("# DETERMINISTIC FACTS (authoritative — copy verbatim)\n```json\n"), body,
        F.lit("\n```\n\n# REDUCED TRANSCRIPTS (chronological; code bodies stripped)\n"),
    )
    return facts.select("cluster_id", "slug", "n_conversations", text.alias("facts"))


def bundles(
    facts: DataFrame, members: DataFrame, budget: int = CHAR_BUDGET, part_chars: int = PART_CHARS
) -> DataFrame:
    """Text of each cluster: facts, then the member blocks oldest first, in parts.

    Every member gets at least its header, so a cluster of very many members is
    longer than its budget. It then comes as several rows ``(cluster_id, part_no,
    text)`` of about ``part_chars``; ordinary bundles are one row.
    """
    room = facts.select("cluster_id", (F.lit(budget) - F.length("facts")).alias("_room"))
    blocks = member_blocks(members.join(room, "cluster_id"), F.col("_room"))
    day = F.floor(F.col("create_time") / 86400).cast("bigint")
    packed = pack_text(blocks, "cluster_id", ["create_time", "conv_id"], "block", "", part_chars, block=day)
    text = F.when(F.col("part_no") == 0, F.concat("facts", "body")).otherwise(F.col("body"))
    named = facts.join(packed.withColumnRenamed("text", "body"), "cluster_id", "left").fillna({"part_no": 0, "body": ""})
    return named.select(
        "cluster_id", "slug", "n_conversations", "part_no", text.alias("text"), F.length(text).alias("chars")
    )


def bundle_index(parts: DataFrame) -> DataFrame:
    """One row per bundle: size over all parts and a hash of the content.

    The hash of a one-part bundle is that of its text; longer ones hash the
    hashes of their parts in order.
    """
    one = F.sha2("text", 256)
    hashed = parts.select("cluster_id", "slug", "n_conversations", "part_no", "chars", one.alias("sha"))
    sums = hashed.groupBy("cluster_id", "slug", "n_conversations").agg(
        F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n_parts"),
        F.array_sort(F.collect_list(F.struct("part_no", "sha"))).alias("_shas"),
    )
    joined = F.array_join(F.transform("_shas", lambda s: s["sha"]), "")
    sha = F.when(F.col("n_parts") == 1, joined).otherwise(F.sha2(joined, 256))
    return sums.withColumn("bundle_sha", sha).drop("_shas")
