"""Quality, accuracy and run comparison over labelled items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions import text as T
from chatloom.operators.classify import tier_weight

DEPTH_CAP = 3


def depth(n: Column) -> Column:
    """Graded completeness of a set: 0 when empty, 1 at three entries or more."""
    return F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(DEPTH_CAP)) / F.lit(float(DEPTH_CAP))


def filled_share(fields: Column) -> Column:
    """Share of map values that are neither blank text nor an empty list (values as JSON or text)."""
    values = F.map_values(fields)
    full = F.filter(values, lambda v: ~F.coalesce(T.strip(v), F.lit("")).isin("", '""', "[]", "null"))
    return F.when(F.size(fields) > 0, F.size(full) / F.size(fields)).otherwise(F.lit(0.0))


def succeeded(llm_ok: Column, source: Column, goal: Column, n_objectives: Column) -> Column:
    """Did a model really write the record? Old records without the flag fall back to their content."""
    wrote = (T.strip(F.coalesce(goal, F.lit(""))) != "") | (F.coalesce(n_objectives, F.lit(0)) > 0)
    return F.coalesce(
        llm_ok, F.when(source == "deterministic_prior", F.lit(False)).when(source == "llm", F.lit(True)), wrote
    )


def measured(items: DataFrame) -> DataFrame:
    """Add success, schema flag and the four 0..1 axes to item rows.

    Needs: llm_ok, classification_source, schema_valid, goal, objectives,
    requirements, archetype_fields.
    """
    n_obj = F.greatest(F.coalesce(F.size("objectives"), F.lit(0)), F.lit(0))
    ok = succeeded(F.col("llm_ok"), F.col("classification_source"), F.col("goal"), n_obj)
    goal = (T.strip(F.coalesce("goal", F.lit(""))) != "").cast("double")
    return items.select(
        "*",
        ok.alias("success"),
        F.coalesce("schema_valid", ok).alias("schema_ok"),
        goal.alias("q_goal"),
        depth(F.size("objectives")).alias("q_objectives"),
        depth(F.size("requirements")).alias("q_requirements"),
        F.coalesce(filled_share(F.col("archetype_fields")), F.lit(0.0)).alias("q_fields"),
    )


def pct(share: Column) -> Column:
    return F.bround(share * 100, 0)


def quality_rows(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reliability, depth and schema validity per group, kept apart.

    ``rows``: success, schema_ok, q_goal, q_objectives, q_requirements, q_fields.
    Failures lower completion but never enter the depth axes.
    """
    on_success = lambda c: F.coalesce(F.avg(F.when(F.col("success"), F.col(c))), F.lit(0.0))
    axes = {
        "goal_pct": on_success("q_goal"),
        "objectives_pct": on_success("q_objectives"),
        "requirements_pct": on_success("q_requirements"),
        "archetype_fields_pct": on_success("q_fields"),
    }
    rate = lambda c: F.avg(F.col(c).cast("double"))
    both = sum(axes.values(), F.lit(0.0)) / 4
    return rows.groupBy(*by).agg(
        pct(rate("success")).alias("completion_pct"),
        pct(both).alias("depth_on_success_pct"),
        pct(rate("schema_ok")).alias("schema_valid_pct"),
        *[pct(c).alias(n) for n, c in axes.items()],
        F.count_if("success").alias("completed"),
        F.count(F.lit(1)).alias("n_items"),
    )


def first_per_model(items: DataFrame, model: str, item: str, order: Sequence[str]) -> DataFrame:
    """One row per (model, item): the first in file order, found by an aggregate instead of a sort."""
    rest = [c for c in items.columns if c not in (model, item)]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return items.groupBy(model, item).agg(first.alias("r")).select(model, item, *[F.col(f"r.{c}").alias(c) for c in rest])


def leaderboard(items: DataFrame, model: str = "model", item: str = "slug", order: Sequence[str] = ("file", "pos")) -> DataFrame:
    """One row per model over all its files; runs classified only by rules are left out."""
    kept = items.where(F.coalesce("doc_source", F.lit("")) != "deterministic_prior")
    return quality_rows(measured(first_per_model(kept, model, item, order)), [model])


def quality_order() -> list[Column]:
    return [F.desc("completion_pct"), F.desc("depth_on_success_pct"), F.desc("schema_valid_pct")]


# --- accuracy against a reference run -------------------------------------


def reference_key(items: DataFrame) -> DataFrame:
    """Answer key: completed items of the reference run that carry both classes."""
    return items.where("success AND archetype IS NOT NULL AND domain IS NOT NULL").select(
        "slug", F.col("archetype").alias("ref_archetype"), F.col("domain").alias("ref_domain")
    )


def graded(items: DataFrame, key: DataFrame) -> DataFrame:
    """Completed items that the key covers, with ``correct`` (a missing class counts as wrong)."""
    same = (F.col("archetype") == F.col("ref_archetype")) & (F.col("domain") == F.col("ref_domain"))
    return items.where("success").join(key, "slug").withColumn("correct", F.coalesce(same, F.lit(False)).cast("int"))


def accuracy(graded_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return graded_rows.groupBy(*by).agg(
        pct(F.avg("correct")).alias("accuracy_pct"), F.count(F.lit(1)).alias("accuracy_n")
    )


def weighted_accuracy(graded_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy weighted by difficulty tier over items that have a checkable answer."""
    w = tier_weight(F.col("tier"))
    return (
        graded_rows.where(F.coalesce("verifiability_class", F.lit("")) != "subjective")
        .groupBy(*by)
        .agg(pct(F.sum(w * F.col("correct")) / F.sum(w)).alias("iq"), F.count(F.lit(1)).alias("n"))
    )


def accuracy_by(graded_rows: DataFrame, by: Sequence[str], cell: str) -> DataFrame:
    """Long accuracy table per skill or difficulty cell."""
    return (
        graded_rows.where((F.coalesce("verifiability_class", F.lit("")) != "subjective") & F.col(cell).isNotNull())
        .groupBy(*by, cell)
        .agg(pct(F.avg("correct")).alias("pct"), F.count(F.lit(1)).alias("n"))
    )


def pivot_cells(long: DataFrame, by: Sequence[str], cell: str, values: Sequence[str]) -> DataFrame:
    return long.groupBy(*by).pivot(cell, list(values)).agg(F.first("pct"))


# --- two runs -------------------------------------------------------------


def align(a: DataFrame, b: DataFrame, key: str = "slug") -> DataFrame:
    """Full outer match of two runs; side columns are prefixed a_ and b_."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key], F.lit(True).alias("in_a"))
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key], F.lit(True).alias("in_b"))
    return left.join(right, key, "full_outer").fillna(False, ["in_a", "in_b"])


def compare(pairs: DataFrame) -> DataFrame:
    """Overlap, agreement and head-to-head fill of two aligned runs.

    The archetype rate is over items both runs classified, the domain rate over
    the whole overlap; the two denominators differ on purpose.
    """
    both = F.col("in_a") & F.col("in_b")
    classified = both & F.col("a_archetype").isNotNull() & F.col("b_archetype").isNotNull()
    says = lambda s: T.strip(F.coalesce(f"{s}_goal", F.lit(""))) != ""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    out = [
        n(both).alias("n_overlap"),
        n(F.col("in_a") & ~F.col("in_b")).alias("n_a_only"),
        n(F.col("in_b") & ~F.col("in_a")).alias("n_b_only"),
        n(classified).alias("n_both_classified"),
        n(classified & (F.col("a_archetype") != F.col("b_archetype"))).alias("n_archetype_diffs"),
        F.avg(F.when(classified, (F.col("a_archetype") == F.col("b_archetype")).cast("double"))).alias("archetype_agree_rate"),
        F.avg(F.when(both, F.coalesce((F.col("a_domain") == F.col("b_domain")), F.lit(False)).cast("double"))).alias("domain_agree_rate"),
        n(both & says("a") & says("b")).alias("goal_both"),
        n(both & says("a") & ~says("b")).alias("goal_a_only"),
        n(both & ~says("a") & says("b")).alias("goal_b_only"),
        n(both & ~says("a") & ~says("b")).alias("goal_neither"),
    ]
    for s in ("a", "b"):
        mean = lambda c: F.avg(F.when(both, c))
        done = F.col(f"{s}_archetype").isNotNull() & F.col(f"{s}_domain").isNotNull() & says(s)
        out += [
            mean(done.cast("double")).alias(f"{s}_classified_rate"),
            mean(says(s).cast("double")).alias(f"{s}_goal_fill"),
            mean((F.col(f"{s}_n_objectives") > 0).cast("double")).alias(f"{s}_objectives_fill"),
            mean((F.col(f"{s}_n_requirements") > 0).cast("double")).alias(f"{s}_requirements_fill"),
            mean(F.col(f"{s}_n_objectives").cast("double")).alias(f"{s}_avg_objectives"),
            mean(F.col(f"{s}_desc_len").cast("double")).alias(f"{s}_avg_desc_len"),
            mean(F.col(f"{s}_af_fill")).alias(f"{s}_af_fill"),
        ]
    return pairs.agg(*out)


def disagreements(pairs: DataFrame, key: str = "slug", n: int = 25) -> DataFrame:
    """The first ``n`` items, by key, that two runs classify differently."""
    return (
        pairs.where("in_a AND in_b AND a_archetype <> b_archetype")
        .select(key, "a_archetype", "b_archetype")
        .orderBy(key)
        .limit(n)
    )


def fill_rate(goal: Column, n_objectives: Column, fields: Column) -> Column:
    """Share of meaningful fields that are filled, contract fields included."""
    n_fields = F.greatest(F.coalesce(F.size(fields), F.lit(0)), F.lit(0))
    full = F.coalesce(filled_share(fields), F.lit(0.0)) * n_fields
    head = (T.strip(F.coalesce(goal, F.lit(""))) != "").cast("int") + (F.coalesce(n_objectives, F.lit(0)) > 0).cast("int")
    return (head + full) / (n_fields + 2)


def classified_rate(items: DataFrame, by: Sequence[str]) -> DataFrame:
    ok = F.col("archetype").isNotNull() & F.col("domain").isNotNull() & (T.strip(F.coalesce("goal", F.lit(""))) != "")
    n_obj = F.size("objectives")
    return items.groupBy(*by).agg(
        F.avg(ok.cast("double")).alias("classified_rate"),
        F.avg(fill_rate(F.col("goal"), n_obj, F.col("archetype_fields"))).alias("fill_rate"),
    )


# --- joining speed and quality --------------------------------------------


def bench_key(model: Column) -> Column:
    name = F.regexp_replace(model, ":+$", "")
    return F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(name, F.lit(":"), name))


def benchmark_rows(quality: DataFrame, perf: DataFrame) -> DataFrame:
    """Full outer join of quality and speed rows on the model key.

    A model with speed only takes its reliability from the trace counts; a metric
    that was not measured stays null.
    """
    q = quality.withColumn("model_key", bench_key(F.col("model"))).drop("model").withColumn("_q", F.lit(True))
    p = perf.withColumn("model_key", bench_key(F.col("model"))).select(
        "model_key", F.col("completed").alias("p_completed"), F.col("attempted").alias("p_attempted"),
        F.col("completion_rate").alias("p_rate"),
        *[c for c in ("sec_per_item", "warm_sec_per_item", "gen_tok_s", "usd_per_1k_items", "wh_per_item") if c in perf.columns],
    )
    both = q.join(p, "model_key", "full_outer")
    seen = F.col("_q").isNotNull()
    pick = lambda a, b: F.when(seen, F.col(a)).otherwise(b)
    return (
        both.withColumn("n_items", pick("n_items", F.col("p_attempted")))
        .withColumn("completed", pick("completed", F.col("p_completed")))
        .withColumn("completion_pct", pick("completion_pct", pct(F.col("p_rate"))))
        .drop("_q", "p_completed", "p_attempted", "p_rate")
    )


def upsert_report(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows over kept rows, nothing deleted, ``changed`` where a fresh row differs."""
    cols = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*cols).alias("old"))
    new = fresh.select(key, F.struct(*cols).alias("new"))
    both = old.join(new, key, "full_outer")
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    return both.withColumn("row", F.coalesce("new", "old")).select(
        key, *[F.col(f"row.{c}").alias(c) for c in cols], changed.alias("changed")
    )
