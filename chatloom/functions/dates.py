"""Dates and recency. ``now`` is always a parameter, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(c: Column) -> Column:
    return F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")


def epoch_to_date(epoch: Column) -> Column:
    """UTC day of an epoch; unknown and zero epochs have none."""
    return F.when(epoch != 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"))


def parse_when(text: Column) -> Column:
    """Timestamp of an ISO text, else of its first ten characters, else null."""
    t = F.trim(text)
    whole = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))
    return F.coalesce(whole, F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))


def recency_weight(when: Column, now: Column, half_life_days: float = 365.0) -> Column:
    """0.5 ** (age / half-life); 1 for unknown or future dates or without decay."""
    if half_life_days <= 0:
        return F.lit(1.0)
    age = (F.unix_micros(now) - F.unix_micros(when)) / F.lit(86400e6)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(half_life_days)), F.lit(1.0))
