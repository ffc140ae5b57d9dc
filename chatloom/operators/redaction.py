"""Findings, public records, reviews and the egress gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.banks import LOCAL_PROVIDERS, STRIP_FIELDS
from chatloom.functions import redact, text as T


def findings(df: DataFrame, key: str, text: str, custom: Sequence[redact.Pattern] = ()) -> DataFrame:
    """Long table ``(key, kind, match)``; one row per hit, found without a shuffle."""
    return df.select(key, F.explode(redact.find(F.col(text), custom)).alias("f")).select(key, "f.kind", "f.match")


def public_items(items: DataFrame, scrub: bool = True, custom: Sequence[redact.Pattern] = ()) -> DataFrame:
    """Items without internal columns, archive paths cut to base names, texts scrubbed."""
    out = items.drop(*[c for c in STRIP_FIELDS if c in items.columns])
    if "version_zip_files" in out.columns:
        out = out.withColumn(
            "version_zip_files",
            F.transform("version_zip_files", lambda z: z.withField("filename", T.base_name(z["filename"]))),
        )
    return redact.scrub_frame(out, custom) if scrub else out


def review(df: DataFrame, key: str, fields: Sequence[str], custom: Sequence[redact.Pattern] = ()) -> DataFrame:
    """Findings per named text field as ``(key, field, kind, match)``; any row fails the review."""
    long = df.select(
        key,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        ).alias("x"),
    ).select(key, "x.field", "x.value")
    return (
        long.where(T.has_text(F.col("value")))
        .select(key, "field", F.explode(redact.find(F.col("value"), custom)).alias("f"))
        .select(key, "field", "f.kind", F.substring("f.match", 1, 80).alias("match"))
    )


def scrub_trace(events: DataFrame, custom: Sequence[redact.Pattern] = ()) -> DataFrame:
    """Trace events with scrubbed message and payload; numbers and counts stay."""
    return redact.scrub_frame(events, custom, only=["message", "payload"])


def egress_blocked(provider: Column, scrubbed: Column, allow_raw: Column) -> Column:
    """True where raw text would leave for a remote provider without leave to do so."""
    return ~provider.isin(LOCAL_PROVIDERS) & ~scrubbed & ~allow_raw


def guard_egress(jobs: DataFrame) -> DataFrame:
    """Jobs that may run. Refuses when any planned job would send raw text."""
    if not jobs.where(egress_blocked(F.col("provider"), F.col("scrub"), F.col("allow_raw"))).isEmpty():
        raise PermissionError("raw text for a remote provider: scrub it or allow raw egress")
    return jobs
