"""Catalog queries over cards, clusters, items and archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom import banks
from chatloom.functions import text as T


def is_project(n_versions: Column, n_conversations: Column) -> Column:
    return (F.coalesce(n_versions, F.lit(0)) >= 1) | (F.coalesce(n_conversations, F.lit(0)) >= 2)


def cluster_matches(clusters: DataFrame, titles: DataFrame, query: str | None) -> DataFrame:
    """Clusters whose slug, readable slug or any member title matches."""
    if not query:
        return clusters
    slug = F.col("slug")
    direct = clusters.where(T.name_matches(slug, query) | T.name_matches(T.human_title(slug), query)).select("cluster_id")
    by_title = titles.where(T.name_matches(F.col("title"), query)).select("cluster_id")
    return clusters.join(direct.unionByName(by_title).distinct(), "cluster_id", "left_semi")


def categories(archetype: Column, durable: Column) -> Column:
    """Browse buckets of an item; one item may be in several."""
    d = F.coalesce(durable, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(archetype == "software_app", F.lit("app")),
            F.when(d, F.lit("project")),
            F.when(archetype.isin(banks.IDEA_ARCHETYPES) & ~d, F.lit("idea")),
        )
    )


def project_order() -> list[Column]:
    return [F.desc("n_versions"), F.desc_nulls_last("end_date"), F.desc("n_conversations"), F.asc("slug")]


def list_projects(clusters: DataFrame, include_all: bool = False, limit: int = 0) -> DataFrame:
    keep = clusters if include_all else clusters.where(is_project(F.col("n_versions"), F.col("n_conversations")))
    rows = keep.select(
        "cluster_id", "slug", T.human_title(F.col("slug")).alias("title"), "n_conversations", "n_versions", "start_date", "end_date"
    ).orderBy(*project_order())
    return rows.limit(limit) if limit > 0 else rows


def enriched_projects(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Clusters with their summary item; ``classified`` tells whether there is one."""
    known = items.select(
        "slug", F.col("title").alias("item_title"), "archetype", "is_durable_project", "goal",
        F.col("n_passes").alias("item_passes"), F.lit(True).alias("classified"),
    )
    return clusters.join(known, "slug", "left").select(
        "cluster_id", "slug",
        F.coalesce(F.nullif("item_title", F.lit("")), T.human_title(F.col("slug"))).alias("title"),
        "archetype",
        categories(F.col("archetype"), F.col("is_durable_project")).alias("categories"),
        F.coalesce("is_durable_project", F.lit(False)).alias("is_durable_project"),
        "n_conversations", "n_versions", F.coalesce("item_passes", "n_versions").alias("n_passes"),
        "start_date", "end_date",
        F.coalesce("goal", F.lit("")).alias("goal"),
        F.coalesce("classified", F.lit(False)).alias("classified"),
    )


def chat_rows(members: DataFrame, cards: DataFrame) -> DataFrame:
    """Member chats of clusters with card facts; ids without a card are kept."""
    facts = cards.select(
        "conv_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")).alias("title"),
        F.coalesce("update_date", "create_date").alias("update_date"), "n_turns", "source_zip",
    )
    return members.select("cluster_id", "conv_id").join(facts, "conv_id", "left").fillna("(untitled)", ["title"]).fillna(0, ["n_turns"])


def category_tree(projects: DataFrame, wanted: Sequence[str] = tuple(banks.CATEGORIES), per_category: int = 0) -> DataFrame:
    """Classified projects per browse category, best first."""
    rows = projects.where("classified").withColumn("category", F.explode("categories")).where(F.col("category").isin(list(wanted)))
    if per_category <= 0:
        return rows
    # There are few categories, so a rank is only taken where its limit keeps the groups small.
    order = Window.partitionBy("category").orderBy(*project_order())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_category)


def uncategorized_chats(cards: DataFrame, members: DataFrame, projects: DataFrame) -> DataFrame:
    """Chats that belong to no classified project."""
    covered = members.join(projects.where("classified").select("cluster_id"), "cluster_id", "left_semi").select("conv_id")
    return cards.join(covered, "conv_id", "left_anti")


def list_chats(cards: DataFrame, query: str | None = None, limit: int = 0) -> DataFrame:
    rows = cards.where(T.name_matches(F.col("title"), query)).orderBy(F.desc_nulls_last("update_date"), "conv_id")
    return rows.limit(limit) if limit > 0 else rows


def mixed_search(projects: DataFrame, chats: DataFrame, limit: int) -> DataFrame:
    """Matching projects first, then chats, up to ``limit``.

    Both sides: id, title, end_date, n_versions, n_conversations. Each side is cut
    to ``limit`` on its own before the union.
    """
    p = projects.orderBy(F.desc("n_versions"), F.desc_nulls_last("end_date"), F.desc("n_conversations"), "id").limit(limit)
    c = chats.orderBy(F.desc_nulls_last("end_date"), "id").limit(limit)
    both = p.withColumn("kind", F.lit("project")).withColumn("_src", F.lit(0)).unionByName(
        c.withColumn("kind", F.lit("chat")).withColumn("_src", F.lit(1))
    )
    return both.orderBy(
        "_src", F.desc("n_versions"), F.desc_nulls_last("end_date"), F.desc("n_conversations"), "id"
    ).limit(limit).drop("_src")


def search_texts(docs: DataFrame, pattern: str, key: str = "id", scope_all: bool = False, **how) -> DataFrame:
    """Chats that match in the text, else in the title, else in a file name; with a snippet.

    ``docs``: key, title, update_date, text and, for the file scope, ``files``.
    """
    text = F.col("text")
    where = F.when(T.text_matches(text, pattern, **how), F.lit("text"))
    snippet = F.when(F.col("matched_in") == "text", T.first_matching_line(text, pattern, **how))
    if scope_all:
        named = F.filter("files", lambda f: T.text_matches(f, pattern, **how))
        where = where.when(T.text_matches(F.col("title"), pattern, **how), F.lit("title")).when(F.size(named) > 0, F.lit("file"))
        snippet = snippet.when(F.col("matched_in") == "title", F.col("title")).when(
            F.col("matched_in") == "file", F.try_element_at(named, F.lit(1))
        )
    return (
        docs.withColumn("matched_in", where)
        .where("matched_in IS NOT NULL")
        .select(key, "title", "update_date", "matched_in", snippet.alias("snippet"))
    )


def search_files(cards: DataFrame, pattern: str, attachments: str, files: str, **how) -> DataFrame:
    """Chats whose attachment or file names match, with the distinct matching names in order."""
    names = F.concat(F.coalesce(attachments, F.array().cast("array<string>")), F.coalesce(files, F.array().cast("array<string>")))
    hit = F.array_distinct(F.filter(names, lambda n: T.text_matches(n, pattern, **how)))
    return cards.withColumn("matched_files", hit).where(F.size("matched_files") > 0)


def context_windows(
    docs: DataFrame, key: str, text: str, regex: str, before: int = 8, after: int = 3,
    context: int | None = None, max_parts: int = 0, max_lines: int = 0, reverse: bool = False,
) -> DataFrame:
    """Blocks of lines around every matching line, as rows ``(key, p, matched_line, start, end, block)``.

    Worked out inside the row (a text is one value), so nothing is shuffled.
    ``context`` asks for a centred block of that many lines (1 or less: only the
    line). ``max_parts`` and ``max_lines`` are the report's own limits; with
    ``reverse`` they keep the last parts instead of the first.
    """
    if context is None:
        above, below = before, after
    else:
        extra = max(context - 1, 0)
        above = extra // 2
        below = extra - above
    only_line = context is not None and context <= 1
    lines = F.split(F.col(text), "\n")
    hits = F.filter(
        F.transform(lines, lambda ln, i: F.when(ln.rlike(regex), i + 1)), lambda m: m.isNotNull()
    )
    total = F.size(lines)
    parts = F.transform(
        hits,
        lambda m: F.struct(
            m.alias("matched_line"), F.greatest(F.lit(1), m - above).alias("start"), F.least(total, m + below).alias("end")
        ),
    )
    df = docs.select(key, lines.alias("_lines"), parts.alias("_parts"), F.size(hits).alias("total_found"))

    def ends(cap: int) -> Column:
        return F.slice("_parts", F.greatest(F.size("_parts") - cap + 1, F.lit(1)), F.lit(cap)) if reverse else F.slice("_parts", 1, cap)

    if max_parts > 0:
        df = df.withColumn("_parts", F.when(F.size("_parts") > 0, ends(max_parts)).otherwise(F.col("_parts")))
    if max_lines > 0 and only_line:
        df = df.withColumn("_parts", F.when(F.size("_parts") > 0, ends(max_lines)).otherwise(F.col("_parts")))
    elif max_lines > 0:
        df = df.withColumn("_parts", _trim(F.col("_parts"), max_lines, reverse))

    # Blocks are cut inside the row, so no match carries the lines of the whole text.
    def with_blocks(all_lines: Column) -> Column:
        block = lambda p: F.array_join(F.slice(all_lines, p["start"], p["end"] - p["start"] + 1), "\n")
        return F.transform("_parts", lambda p: F.struct(
            p["matched_line"].alias("matched_line"), p["start"].alias("start"), p["end"].alias("end"), block(p).alias("block")))

    return df.select(key, "total_found", F.posexplode(T.let(F.col("_lines"), with_blocks)).alias("at", "part")).select(
        key, (F.col("at") + 1).alias("p"), "part.matched_line", "part.start", "part.end", "total_found", "part.block"
    )


def _trim(parts: Column, max_lines: int, reverse: bool) -> Column:
    """Cut a part list to ``max_lines`` lines in all; the part on the border is shortened.

    A part has a line at least, so only the first ``max_lines`` parts are looked at.
    """
    walk = F.slice(F.reverse(parts) if reverse else parts, 1, max_lines)
    sized = F.transform(walk, lambda p: p["end"] - p["start"] + 1)

    def cut(p: Column, i: Column) -> Column:
        used = F.aggregate(F.slice(sized, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        room = F.greatest(F.lit(max_lines) - used, F.lit(0))
        keep = F.least(room, p["end"] - p["start"] + 1)
        start = p["end"] - keep + 1 if reverse else p["start"]
        end = p["end"] if reverse else p["start"] + keep - 1
        return F.when(keep > 0, F.struct(p["matched_line"].alias("matched_line"), start.alias("start"), end.alias("end")))

    kept = F.array_compact(F.transform(walk, cut))
    return F.reverse(kept) if reverse else kept


# --- statistics -----------------------------------------------------------


def info(cards: DataFrame) -> DataFrame:
    day = F.coalesce("update_date", "create_date")
    return cards.agg(
        F.count(F.lit(1)).alias("n_chats"),
        *[F.sum(c).alias(c) for c in ("n_turns", "n_user_turns", "n_assistant_turns")],
        F.min(day).alias("date_min"),
        F.max(day).alias("date_max"),
    )


def state(clusters: DataFrame) -> DataFrame:
    project = is_project(F.col("n_versions"), F.col("n_conversations"))
    return clusters.agg(
        F.count_if(project).alias("n_projects"),
        F.count_if(project & (F.col("n_versions") > 0)).alias("n_projects_with_zips"),
        F.least(F.min("start_date"), F.min("end_date")).alias("date_min"),
        F.greatest(F.max("start_date"), F.max("end_date")).alias("date_max"),
    )


def runs_summary(runs: DataFrame) -> DataFrame:
    """Number of registered runs and the label of the newest."""
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.max_by("label", F.struct("updated", "label")).alias("latest"))


def archive_status(ledger: DataFrame, on_disk: DataFrame, owned: DataFrame) -> DataFrame:
    """State of every archive known from the ledger, the disk or the chats that name it.

    ``ledger``: basename, seen, written, skipped, size, last_processed. ``on_disk``:
    basename, path, file_size. ``owned``: basename, chats.
    """
    from chatloom.operators.ingest import ledger_status

    all3 = ledger.withColumn("_l", F.lit(True)).join(on_disk, "basename", "full_outer").join(owned, "basename", "full_outer")
    status = (
        F.when(F.col("_l").isNotNull(), ledger_status(F.col("seen"), F.col("written"), F.col("skipped")))
        .when(F.col("path").isNotNull(), F.lit("not_processed"))
        .when(F.coalesce("chats", F.lit(0)) > 0, F.lit("indexed"))
        .otherwise(F.lit("missing"))
    )
    return all3.select(
        "basename", "path", T.export_date(F.col("basename")).alias("export_date"),
        F.coalesce("size", "file_size").alias("size_bytes"), status.alias("status"),
        F.coalesce("chats", F.lit(0)).alias("chats_in_store"), "seen", "written", "skipped", "last_processed",
    )


def archive_order() -> list[Column]:
    return [F.desc_nulls_last("export_date"), F.desc_nulls_last("last_processed"), F.desc("basename")]


def id_coverage(catalog: DataFrame, exports: DataFrame, newest: Column, key: str) -> DataFrame:
    """One row per id with where it is known: catalog, any export, the newest export.

    All completeness checks are counts over this table, so each input is read and
    shuffled once.
    """
    sides = catalog.select(key, F.lit(1).alias("c"), F.lit(0).alias("e"), F.lit(0).alias("n")).unionByName(
        exports.select(key, F.lit(0).alias("c"), F.lit(1).alias("e"), newest.cast("int").alias("n"))
    )
    return sides.groupBy(key).agg(F.max("c").alias("in_catalog"), F.max("e").alias("in_export"), F.max("n").alias("in_newest"))


def completeness(coverage: DataFrame) -> DataFrame:
    c, e, n = (F.col(x) == 1 for x in ("in_catalog", "in_export", "in_newest"))
    return coverage.agg(
        F.count_if(c).alias("n_catalog"),
        F.count_if(e).alias("n_union"),
        F.count_if(n).alias("n_newest"),
        F.count_if(c & ~n).alias("older_only"),
        F.count_if(e & ~c).alias("missing_from_catalog"),
        F.count_if(c & ~e).alias("not_in_any_export"),
        F.count_if(n & ~c).alias("newest_missing"),
    )


def verdict(counts: DataFrame, files_ok: Column, parsed_full: Column) -> DataFrame:
    """Named checks as rows and the overall verdict over them."""
    checks = {
        "files_on_disk": files_ok,
        "parse_complete": parsed_full,
        "newest_in_catalog": F.col("newest_missing") == 0,
        "catalog_in_exports": F.col("not_in_any_export") == 0,
        "export_union": F.col("missing_from_catalog") == 0,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("ok")) for k, v in checks.items()])
    return counts.select(F.explode(rows).alias("r")).select("r.check_id", "r.ok")


def chat_meta(cards: DataFrame, conv_id: str) -> DataFrame:
    """Header of one chat (the key filter reaches the scan)."""
    return cards.where(F.col("conv_id") == conv_id).select(
        "conv_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")).alias("title"),
        F.coalesce("update_date", "create_date").alias("update_date"), "n_turns", "source_zip",
    )
