"""Small labels and estimates over single columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Planning rates, seconds per item and per GiB of export.
SECONDS_PER_ITEM = {
    "ollama": 45,
    "codex": 28,
    "claude": 30,
    "cursor": 30,
    "openai": 8,
    "anthropic": 8,
}
DEFAULT_SECONDS_PER_ITEM = 30
EXTRACT_SECONDS_PER_GIB = 90
EXTRACT_FLOOR_SECONDS = 20


def duration(seconds: Column) -> Column:
    """Compact elapsed time that never reads as zero."""
    return (
        F.when(seconds >= 10, F.format_string("%.0fs", seconds))
        .when(seconds >= 0.1, F.format_string("%.1fs", seconds))
        .when(seconds >= 0.0005, F.format_string("%.0fms", seconds * 1000))
        .otherwise(F.lit("<1ms"))
    )


def planned_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("double")
    minutes = whole / 60
    return (
        F.when(whole < 90, F.format_string("~%.0fs", whole))
        .when(minutes < 90, F.format_string("~%.0f min", minutes))
        .otherwise(F.format_string("~%.1f hr", minutes / 60))
    )


def file_size(num_bytes: Column) -> Column:
    b = num_bytes.cast("double")
    out = F.format_string("%.1f TB", b / F.lit(1024.0**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(b < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", b / F.lit(1024.0**power))).otherwise(out)
    return F.when(b < 1024, F.format_string("%.0f B", b)).otherwise(out)


def extract_estimate_seconds(num_bytes: Column) -> Column:
    gib = F.greatest(num_bytes.cast("double"), F.lit(0.0)) / F.lit(1024.0**3)
    return F.floor(F.greatest(F.lit(float(EXTRACT_FLOOR_SECONDS)), gib * EXTRACT_SECONDS_PER_GIB)).cast("bigint")


def item_estimate_seconds(provider: Column, n_items: Column) -> Column:
    rate = F.lit(DEFAULT_SECONDS_PER_ITEM)
    for name, secs in SECONDS_PER_ITEM.items():
        rate = F.when(provider == name, F.lit(secs)).otherwise(rate)
    return (rate * F.greatest(n_items, F.lit(0))).cast("bigint")


def remaining_seconds(elapsed: Column, done: Column, left: Column) -> Column:
    """Projected time of the remaining items; null before the first item is done."""
    return F.when(left <= 0, F.lit(0.0)).when(done > 0, elapsed / done * left)


def placement(gpu_fraction: Column) -> Column:
    cpu = F.bround((1 - gpu_fraction) * 100).cast("int").cast("string")
    gpu = F.bround(gpu_fraction * 100).cast("int").cast("string")
    return (
        F.when(gpu_fraction >= 0.99, F.lit("100% GPU"))
        .when(gpu_fraction <= 0.01, F.lit("100% CPU"))
        .otherwise(F.concat(cpu, F.lit("%/"), gpu, F.lit("% CPU/GPU")))
    )


def token_id(c: Column) -> Column:
    """Coerce a label to a safe id."""
    safe = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._:-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("x"))


def workload(label: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """First matching rule ``(regex, workload)`` wins; other labels are their own workload."""
    out = token_id(F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown")))
    for regex, name in reversed(list(rules)):
        out = F.when(label.rlike(regex), F.lit(name)).otherwise(out)
    return out


def billing_label(kind: Column, plan_label: Column, plan_id: Column, price: Column, period: Column, metered: Column) -> Column:
    short = F.when(period == "month", "mo").when(period == "year", "yr")
    priced = F.coalesce(F.concat(F.lit(" $"), number_text(price), F.lit("/"), short), F.lit(""))
    plan = F.coalesce(plan_label, plan_id, F.lit("plan"))
    tail = F.when(metered, F.lit(" · metered")).otherwise(F.lit(""))
    return (
        F.when(kind == "local", F.lit("local $0"))
        .when(kind == "token", F.lit("token (pay-per-use)"))
        .when(kind == "subscription", F.concat(plan, priced, tail))
        .otherwise(F.lit(""))
    )


def number_text(c: Column) -> Column:
    """Shortest text of a number: no trailing zeros."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def benchmark_summary(cols: Mapping[str, Column]) -> Column:
    """One line of the measured axes that exist, never blended."""
    g = cols.get
    parts = [F.when(g("completed").isNotNull() & g("n_items").isNotNull(),
                    F.concat(F.lit("compl "), number_text(g("completed")), F.lit("/"), number_text(g("n_items"))))]
    for name, fmt in (
        ("depth_on_success_pct", "depth* %.0f%%"),
        ("schema_valid_pct", "json %.0f%%"),
        ("iq", "TWA %.0f"),
        ("accuracy_pct", "acc %.0f%%"),
        ("sec_per_item", "%.1f s/item"),
        ("wh_per_item", "%.3f Wh/item"),
    ):
        if name in cols:
            parts.append(F.when(cols[name].isNotNull(), F.format_string(fmt, cols[name].cast("double"))))
    if "usd_per_1k_items" in cols:
        usd = cols["usd_per_1k_items"].cast("double")
        parts.append(F.when(usd > 0, F.format_string("$%.2f/1k", usd)))
    return F.concat_ws(" · ", *parts)
