"""Quality rules: a decision list learned from labelled statistics, native Spark only.

Statistics of a text are column expressions. The learner bins them, and each step
of sequential covering is one aggregate over the labelled rows that returns a
bounded table of counts (statistics x bins x label); a rule grows by the condition
with the best FOIL gain on two thirds of the rows, is pruned on the other third,
and is taken only if it is precise there. The rules come out as ordered Spark
conditional expressions.

Defined results: a null or empty text has no words and fails the base rule; with
no labels, or one label only, no rule is learned and the base rule decides alone.
Rows repeated in the labels count as often as they stand there. Labels without a
document, or with a null label, teach nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import WORD, stored, text_of, words

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]

#: Learned statistics: name -> (numerator, denominator, bins per unit, bins).
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words", 4, 80),
    "symbol_share": ("n_symbols", "word_chars", 200, 200),
    "upper_share": ("n_upper", "word_chars", 100, 100),
    "mark_share": ("n_marks", "word_chars", 200, 200),
    "digit_share": ("n_digits", "word_chars", 100, 100),
    "repeat_share": ("n_repeat_words", "n_words", 100, 100),
    "dup_line_share": ("n_dup_lines", "n_lines", 100, 100),
}


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``COUNTS`` in a struct column ``_stats``; other columns stay.

    Each select names a column that the next uses more than once, so that arrays
    are built once per row and not again for every element.
    """
    keep = [F.col(c) for c in docs.columns]
    t, w, h, s, p = (F.col(f"_q_{c}") for c in "twhsp")
    n = F.size(w)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    df = docs.select(*keep, text_of(text).alias("_q_t")).select(*keep, t, words(t).alias("_q_w"))
    # One hash per word, then one per window: long arrays instead of strings.
    df = df.select(*keep, t, w, F.transform(w, lambda x: F.xxhash64(x)).alias("_q_h"))
    df = df.select(*keep, t, w, F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")).alias("_q_h"))
    # Only texts with a repeated window pay for the sort.
    df = df.select(*keep, t, w, F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")).alias("_q_s"))
    df = df.select(*keep, t, w, F.sort_array(F.transform(
        F.filter(s, lambda e, i: F.coalesce((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == e["h"]), F.lit(False))
                 | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))),
        lambda e: e["p"],
    )).alias("_q_p"))
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    df = df.select(*keep, t, w, lines.alias("_q_l"), covered.alias("_q_r"))
    full = F.col("_q_l")
    stats = {
        "n_words": n.cast("long"),
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": F.col("_q_r"),
        "n_lines": F.size(full).cast("long"),
        "n_upper": count(r"\p{Lu}"),
        "n_marks": count(r"[!?]"),
        "n_digits": count(r"[0-9]"),
    }
    return df.select(*keep, F.struct(*[stats[c].alias(c) for c in COUNTS]).alias("_stats"))


def base_failed(at: str = "_stats") -> Column:
    n = F.col(f"{at}.n_words")
    return (n < 10) | (100 * F.col(f"{at}.n_repeat_words") > 20 * n)


def _bin(name: str, at: str) -> Column:
    """Bin of a statistic, 0 where the denominator is 0."""
    top, bottom, per_unit, bins = RATIOS[name]
    x = F.col(f"{at}.{top}") * per_unit / F.col(f"{at}.{bottom}")
    return F.coalesce(F.when(F.col(f"{at}.{bottom}") > 0, F.least(F.floor(x), F.lit(bins))), F.lit(0)).cast("int")


@dataclass(frozen=True)
class Condition:
    """``statistic >= edge`` or ``statistic < edge``; the edge is a bin's lower border."""

    name: str
    above: bool
    bin: int

    def column(self, at: str = "_stats") -> Column:
        return self.test(_bin(self.name, at))

    def test(self, binned: Column) -> Column:
        return binned >= self.bin if self.above else binned < self.bin

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.bin / RATIOS[self.name][2]:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & column(c)
    return out


def verdict(rules: list[Rule], at: str = "_stats") -> Column:
    """True where the decision list keeps the text: the first rule that holds rejects it."""
    out = None
    for rule in rules:
        hit = _holds(rule, lambda c: c.column(at))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def fit(
    stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality",
    max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_cover: int = 5,
) -> list[Rule]:
    """Learn rules that reject low quality (label 0) from all labelled rows.

    ``stats`` has the id and ``_stats``. Texts that fail the base rule are decided
    and teach nothing. The driver sees counts per statistic and bin only.
    """
    names = list(RATIOS)
    known = labels.where(F.col(label).isNotNull()).select(F.col(id).alias("_id"), (F.col(label) == 0).alias("_bad"))
    rows = stats.where(~base_failed()).select(
        F.col(id).alias("_id"), (F.pmod(F.xxhash64(id), F.lit(3)) == 0).alias("_prune"), *[_bin(c, "_stats").alias(c) for c in names])
    # Equal bins are one cell: the learner's input shrinks to distinct cells.
    cells = stored(rows.join(known, "_id").groupBy("_prune", "_bad", *names).agg(F.count("*").alias("_n")))
    by_bin = lambda c: c.test(F.col(c.name))
    taken: list[Rule] = []
    for _ in range(max_rules):
        left = cells
        for old in taken:
            left = left.where(~_holds(old, by_bin))
        rule: Rule = ()
        while len(rule) < max_conditions:
            best = _best_condition(left.where(~F.col("_prune") & _holds(rule, by_bin)), names, min_cover)
            if best is None:
                break
            rule += (best[0],)
            if best[1] == 0:
                break
        rule = _pruned(left, rule, by_bin, min_precision, min_cover)
        if not rule:
            break
        taken.append(rule)
    return taken


def _best_condition(rows: DataFrame, names: list[str], min_cover: int) -> tuple[Condition, int] | None:
    """The condition of best gain on the growing rows, and the good rows it still covers."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("bin")) for c in names])).alias("f")
    counts = rows.select("_bad", "_n", pairs).groupBy("f.name", "f.bin").agg(
        F.sum(F.when(F.col("_bad"), F.col("_n")).otherwise(0)).alias("bad"),
        F.sum(F.when(~F.col("_bad"), F.col("_n")).otherwise(0)).alias("good"),
    ).collect()
    best, score = None, 0.0
    for name in names:
        hist = sorted((r["bin"], r["bad"], r["good"]) for r in counts if r["name"] == name)
        bad, good = sum(x[1] for x in hist), sum(x[2] for x in hist)
        if not bad or not good:
            return None
        below_bad = below_good = 0
        for (_, b, g), (edge, _, _) in zip(hist, hist[1:]):
            below_bad, below_good = below_bad + b, below_good + g
            for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                gain = _gain(bad, good, p, n)
                if p >= min_cover and gain > score + 1e-9:
                    best, score = (Condition(name, above, edge), n), gain
    return best


def _pruned(rows: DataFrame, rule: Rule, by_bin, min_precision: float, min_cover: int) -> Rule:
    """The prefix of the rule that is best on the pruning rows, if it is precise enough."""
    if not rule:
        return ()
    prefixes = [rule[: k + 1] for k in range(len(rule))]
    sums = []
    for k, prefix in enumerate(prefixes):
        hit = _holds(prefix, by_bin)
        sums += [F.sum(F.when(hit & F.col("_bad"), F.col("_n")).otherwise(0)).alias(f"p{k}"),
                 F.sum(F.when(hit & ~F.col("_bad"), F.col("_n")).otherwise(0)).alias(f"n{k}")]
    got = rows.where(F.col("_prune")).agg(*sums).first()
    best, score = (), None
    for k, prefix in enumerate(prefixes):
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        if p + n >= min_cover / 2 and p / (p + n) >= min_precision and (score is None or (p - n) / (p + n) > score + 1e-9):
            best, score = prefix, (p - n) / (p + n)
    return best


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """Per row of ``docs``: id, the counts, ``base_failed`` and ``kept``; and the rules."""
    stats = stored(with_stats(docs.select(F.col(id), F.col(text)), text).select(id, "_stats"))
    rules = fit(stats, labels, id, label)
    out = stats.select(id, "_stats.*", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
    return out, rules


def keep_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole. The caller's columns travel in one struct, so no name clashes."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    held = stored(with_stats(rows, "text").select("row", "id", "_stats"))
    rules = fit(held.select(F.col("id").alias(id), "_stats"), labels, id, label)
    return held.where(~base_failed() & verdict(rules)).select(*[F.col("row")[c].alias(c) for c in docs.columns])
