"""Speed, cost and spend over run traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom import banks
from chatloom.plans.blocks import BLOCK, even, running, streaks
from chatloom.session import cut

OK, FAIL = "LLM_OK", "LLM_FAIL"


def model_speed(events: DataFrame, by: str = "run_id", energy: DataFrame | None = None, ok: str = OK, fail: str = FAIL) -> DataFrame:
    """One row per model from its trace; models without a timed success are left out.

    ``events``: by, event_type and payload columns secs, in_tok, out_tok, usd,
    load_ms. ``energy``: by, wh (joined on the run, so a trace is counted once).
    """
    good = F.col("event_type") == ok
    total = lambda c: F.sum(F.when(good, F.coalesce(F.col(c), F.lit(0)))).alias(f"_{c}")
    sums = events.groupBy(by).agg(
        F.count_if(good).alias("completed"),
        F.count_if(F.col("event_type") == fail).alias("_fail"),
        *[total(c) for c in ("secs", "in_tok", "out_tok", "usd", "load_ms")],
    ).where("completed > 0 AND _secs > 0")
    provider = F.element_at(F.split(F.col(by).cast("string"), ":"), 1)
    usd = F.when(provider.isin(banks.SUBSCRIPTION_PROVIDERS), F.lit(0.0)).otherwise(F.col("_usd"))
    if energy is not None:
        sums = sums.join(energy.select(by, "wh"), by, "left")
    else:
        sums = sums.withColumn("wh", F.lit(None).cast("double"))
    n, load = F.col("completed"), F.col("_load_ms") / 1000
    loaded = F.col("_load_ms") > 0
    attempted = n + F.col("_fail")
    return sums.select(
        F.col(by).alias("model"),
        (F.col("_secs") / n).alias("sec_per_item"),
        F.when(loaded, F.greatest(F.col("_secs") - load, F.lit(0.0)) / n).alias("warm_sec_per_item"),
        F.when(loaded, load).alias("load_s"),
        (F.col("_out_tok") / F.col("_secs")).alias("gen_tok_s"),
        ((F.col("_in_tok") + F.col("_out_tok")) / F.col("_secs")).alias("throughput_tok_s"),
        "completed",
        attempted.alias("attempted"),
        (n / attempted).alias("completion_rate"),
        usd.alias("usd_total"),
        (usd / n * 1000).alias("usd_per_1k_items"),
        (F.col("wh") / n).alias("wh_per_item"),
    )


def speed_order() -> list[Column]:
    """Faster first, then more reliable, then the faster generator."""
    return [F.asc("sec_per_item"), F.desc("completion_rate"), F.desc("gen_tok_s")]


def exact_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact median per group, without holding a group's values together.

    Equal values are counted first; the running count goes over blocks of about one
    per cent of the value, so a group of any size spreads over tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    block = F.floor(F.signum("v") * F.log2(F.abs("v") + 1) * 64).cast("bigint")
    placed = running(counts, [by], ["v"], block, {"before": ("sum", F.col("n"))}, inclusive=False)
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("v")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    mid = placed.join(total, by).groupBy(by).agg(at(low).alias("a"), at(high).alias("b"))
    return mid.select(by, (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))


def load_split(items: DataFrame, by: str, seq: str = "sequence") -> DataFrame:
    """Cold-load and warm seconds per run from its successful items.

    Exact where the trace carries load times; else the first item is taken to
    have paid the load and the median of the others is the warm time.
    """
    first = items.groupBy(by).agg(F.min(seq).alias("_first"))
    rows = items.join(first, by)
    later = F.when(F.col(seq) > F.col("_first"), F.col("secs"))
    s = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("secs").alias("total"),
        F.max(F.when(F.col(seq) == F.col("_first"), F.col("secs"))).alias("first_secs"),
        F.count("load_ms").alias("n_load"),
        F.sum(F.coalesce("load_ms", F.lit(0.0))).alias("load_ms"),
        F.sum(F.coalesce("eval_ms", F.lit(0.0))).alias("eval_ms"),
    )
    s = s.join(exact_median(rows.withColumn("_later", later), by, "_later").withColumnRenamed("median", "warm_median"), by, "left")
    exact = F.col("n_load") > 0
    n = F.col("items")
    est_load = F.when(n >= 2, F.greatest(F.col("first_secs") - F.col("warm_median"), F.lit(0.0))).otherwise(F.lit(0.0))
    est_warm = F.when(n >= 2, F.col("warm_median")).otherwise(F.col("total") / n)
    load = F.col("load_ms") / 1000
    return s.select(
        by,
        "items",
        (F.col("total") / n).alias("s_per_item"),
        F.when(exact, F.greatest(F.col("total") - load, F.lit(0.0)) / n).otherwise(est_warm).alias("warm_s_per_item"),
        F.when(exact, load).otherwise(est_load).alias("load_s"),
        F.when(exact, F.lit("exact")).otherwise(F.lit("est")).alias("load_kind"),
        F.when(exact & (F.col("eval_ms") > 0), F.col("eval_ms") / 1000 / n).alias("gen_only_s_per_item"),
    )


# --- prices ---------------------------------------------------------------


def rates(spark) -> DataFrame:
    return spark.createDataFrame(banks.RATES, "provider string, model string, usd_in double, usd_out double")


def with_rates(usage: DataFrame, rate_rows: DataFrame) -> DataFrame:
    """Add ``usd_in``/``usd_out``: the exact model's rate, else the provider's ``*`` rate, else 0."""
    exact = rate_rows.where("model <> '*'").withColumnsRenamed({"usd_in": "_ei", "usd_out": "_eo"})
    star = rate_rows.where("model = '*'").drop("model").withColumnsRenamed({"usd_in": "_si", "usd_out": "_so"})
    return (
        usage.join(exact, ["provider", "model"], "left")
        .join(star, "provider", "left")
        .withColumn("usd_in", F.coalesce("_ei", "_si", F.lit(0.0)))
        .withColumn("usd_out", F.coalesce("_eo", "_so", F.lit(0.0)))
        .drop("_ei", "_eo", "_si", "_so")
    )


def with_shadow_rates(priced: DataFrame) -> DataFrame:
    """Add list-price rates for plan-covered providers, so a budget still bounds their tokens."""
    sin, sout = F.col("usd_in"), F.col("usd_out")
    for name, (i, o) in banks.SHADOW_RATES.items():
        sin = F.when(F.col("provider") == name, F.lit(i)).otherwise(sin)
        sout = F.when(F.col("provider") == name, F.lit(o)).otherwise(sout)
    return priced.withColumn("shadow_in", sin).withColumn("shadow_out", sout)


def usd(in_tok: Column, out_tok: Column, usd_in: Column, usd_out: Column) -> Column:
    return in_tok / F.lit(1e6) * usd_in + out_tok / F.lit(1e6) * usd_out


def estimate(texts: DataFrame, chars: str, by: Sequence[str] = (), out_per_item: int = banks.OUTPUT_TOKENS_PER_ITEM) -> DataFrame:
    """Projected tokens and dollars; ``texts`` carries provider and model."""
    tok = F.floor(F.greatest(F.col(chars), F.lit(0)) / banks.CHARS_PER_TOKEN).cast("bigint")
    keys = [*by, "provider", "model"]
    need = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.sum(tok).alias("est_input_tokens")).withColumn(
        "est_output_tokens", F.col("n_items") * out_per_item
    )
    priced = with_shadow_rates(with_rates(need, rates(texts.sparkSession)))
    ins, outs = F.col("est_input_tokens"), F.col("est_output_tokens")
    real = usd(ins, outs, F.col("usd_in"), F.col("usd_out"))
    shadow = usd(ins, outs, F.col("shadow_in"), F.col("shadow_out"))
    return priced.select(
        *keys, "n_items", "est_input_tokens", "est_output_tokens",
        F.round(real, 4).alias("est_usd"), F.round(real / F.col("n_items"), 5).alias("est_usd_per_item"),
        F.round(shadow, 4).alias("shadow_usd"),
    )


def cost_share(items: DataFrame, batch: Sequence[str], chars: str, total: str) -> DataFrame:
    """Split a batch total over its items by text length (an even text total of 0 gives 0).

    The sum is pre-aggregated and joined back, so one huge batch is not one task.
    """
    sums = items.groupBy(*batch).agg(F.sum(chars).alias("_all"))
    share = F.when(F.col("_all") > 0, F.col(chars) / F.col("_all")).otherwise(F.lit(0.0))
    return items.join(sums, list(batch)).withColumn("share", F.col(total) * share).drop("_all")


# --- breaker --------------------------------------------------------------


def breaker(
    items: DataFrame, run: Sequence[str], seq: str, ok: Column, usd_col: str, block: Column | None = None,
    max_failures: int = 3, max_usd: float | None = None,
) -> DataFrame:
    """Mark the items a run skips after its breaker trips.

    The breaker trips on ``max_failures`` failures in a row or once the spend so
    far reaches ``max_usd``; the tripping item itself still ran. Streaks and spend
    are worked out over blocks, so a run of any length spreads over tasks, and
    written once, because finding the first trip and marking what follows both
    read them.
    """
    run = list(run)
    placed = even(items, run, [seq]) if block is None else items.withColumn(BLOCK, block)
    spent = running(placed, run, [seq], F.col(BLOCK), {"spent": ("sum", F.col(usd_col))})
    marks = cut(streaks(spent, run, [seq], F.col(BLOCK), ~ok, "streak"))
    trips = F.col("streak") >= max_failures
    if max_usd is not None:
        trips = trips | (F.col("spent") >= max_usd)
    first = marks.where(trips).groupBy(*run).agg(F.min(seq).alias("_trip"))
    after = F.coalesce(F.col(seq) > F.col("_trip"), F.lit(False))
    return marks.join(first, run, "left").select(*items.columns, "streak", "spent", after.alias("skipped"))


def run_totals(items: DataFrame, run: Sequence[str], ok: str = "ok", skipped: str = "skipped") -> DataFrame:
    """Items, failures, tokens and spend of a run; skipped items cost nothing."""
    ran = ~F.col(skipped)
    return items.groupBy(*run).agg(
        F.count_if(ran).alias("n_items"),
        F.count_if(ran & ~F.col(ok)).alias("n_failed"),
        F.count_if(F.col(skipped)).alias("n_skipped"),
        F.sum(F.when(ran, F.col("in_tok")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(ran, F.col("out_tok")).otherwise(0)).alias("output_tokens"),
        F.sum(F.when(ran, F.col("usd")).otherwise(0.0)).alias("cost_usd"),
        F.bool_or(skipped).alias("breaker_tripped"),
    )


def stage_seconds(stages: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Seconds each stage took; null while it has not ended."""
    secs = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(1e6)
    return stages.select(*by, secs.alias("seconds"))


def numbered(events: DataFrame, run: Sequence[str], order: Sequence[str], block: Column | None = None) -> DataFrame:
    """Sequence numbers from 1 along each run."""
    return running(events, run, order, block, {"sequence": ("sum", F.lit(1).cast("bigint"))})


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rank inside each group ``by`` (of already aggregated rows)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
