"""URL filters: hand-written rules, and a ratio of two character language models for the rest.

Two variable-order Markov models are counted over all URLs of known verdict, one
for accepted and one for rejected. A context of up to ``order`` characters is kept if
it tells more than the context without its first character: its gain, the
log-likelihood that it adds to its class's characters, is at least ``least_gain`` nats
a character of that class. Probabilities back off to shorter contexts with
Witten-Bell smoothing. A URL's score is the difference of its two log-likelihoods
per character; the threshold is set on a third of the known URLs that the models
have not seen, where the two error rates are least in sum.

Counting is a job over all URLs. The rule for contexts is one of shares, so it is the
same at every size, and it bounds the table that reaches the tasks: the contexts of
one length share all characters of a class, and none gains more than the log of its
rarest character's share, so that ``least_gain`` leaves at most some
10 / ``least_gain`` of each length and class, whatever the input.

Defined results: a null URL or one without ``://`` has an empty host and path, no
rule, and is scored as the text it is (null as empty); a URL with no characters has
score 0. With no accepted or no rejected example the models say nothing and
everything without a rule is allowed. Repeated URLs count as often as they stand
there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.llm.common import arrow_batches, stored

ACCEPT, REJECT = "allow", "block"
#: Stands before a URL's first character, so that contexts know the start.
START = "\x02"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """``allow example.net/en/`` or ``block net/``."""
    verdict, _, place = line.partition(" ")
    host, slash, path = place.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none fits. Rules are a short written list."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Model:
    """Counts of the characters after each context, for accepted (0) and rejected (1) URLs."""

    order: int
    contexts: dict[str, tuple[dict[str, int], dict[str, int]]]
    alphabet: int
    threshold: float = 0.0
    #: Share of accepted and of rejected held-out URLs that the threshold judges wrongly.
    errors: tuple[float, float] = (0.0, 0.0)

    def tables(self) -> list[dict[str, tuple[int, dict[str, int]]]]:
        """Per class: context -> (count, count of each next character)."""
        return [{c: (sum(n[k].values()), n[k]) for c, n in self.contexts.items() if n[k]} for k in (0, 1)]


def log_prob(url: str, table: dict[str, tuple[int, dict[str, int]]], order: int, alphabet: int) -> float:
    """Natural log-likelihood of a URL's characters."""
    text, total = START + url, 0.0
    for i in range(1, len(text)):
        p = 1.0 / alphabet
        for k in range(min(order, i) + 1):
            found = table.get(text[i - k : i])
            if found is None:  # longer contexts are rarer still
                break
            n, after = found
            kinds = len(after)
            p = (after.get(text[i], 0) + kinds * p) / (n + kinds)
        total += math.log(p)
    return total


def score(url: str, model: Model, tables) -> float:
    """Difference of the log-likelihoods per character, positive for accepted."""
    if not url:
        return 0.0
    good, bad = (log_prob(url, t, model.order, model.alphabet) for t in tables)
    return (good - bad) / len(url)


def counts(known: DataFrame, order: int) -> DataFrame:
    """(context, next, rejected, n) over all rows (url, rejected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def table() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([k[2] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], ["context", "next", "rejected", "n"])

        for batch in batches:
            for url, rejected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = START + url
                seen.update((text[i - k : i], text[i], rejected) for i in range(1, len(text)) for k in range(min(order, i) + 1))
                if len(seen) > 200_000:  # sums are put together after the shuffle
                    yield table()
                    seen.clear()
        yield table()

    parts = known.select("url", "rejected").mapInArrow(run, "context string, next string, rejected boolean, n bigint")
    return parts.groupBy("context", "next", "rejected").agg(F.sum("n").alias("n"))


def telling(learned: DataFrame, least_gain: float) -> DataFrame:
    """(context) of the counts (context, next, rejected, n): those that gain enough, and the shorter ones on the way to them."""
    total = F.sum("n").over(Window.partitionBy("context", "rejected"))
    shares = learned.withColumn("share", F.col("n") / total)
    # Two rows: the characters of each class.
    size = learned.where("context = ''").groupBy("rejected").agg(F.sum("n").alias("size"))
    shorter = shares.select(F.col("context").alias("shorter"), "next", "rejected", F.col("share").alias("before"))
    gains = (
        shares.where("context <> ''").withColumn("shorter", F.expr("substring(context, 2)"))
        .join(shorter, ["shorter", "next", "rejected"]).join(F.broadcast(size), "rejected")
        .groupBy("context", "rejected").agg(F.sum(F.col("n") * F.log(F.col("share") / F.col("before")) / F.col("size")).alias("gain"))
    )
    ends = F.transform(F.sequence(F.lit(1), F.length("context") + 1), lambda at: F.col("context").substr(at, F.length("context")))
    return gains.where(F.col("gain") >= least_gain).select(F.explode(ends).alias("context")).unionByName(
        learned.where("context = ''").select("context")).distinct()


def fit(known: DataFrame, order: int = 4, least_gain: float = 2e-5) -> Model | None:
    """Models and threshold from (url, accepted) rows; None without examples of both verdicts."""
    rows = known.where(F.col("accepted").isNotNull()).select(F.coalesce("url", F.lit("")).alias("url"), (~F.col("accepted")).alias("rejected"))
    held_out = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
    learned = stored(counts(rows.where(~held_out), order))
    # Each context has at most as many rows as there are characters and verdicts.
    table = learned.join(telling(learned, least_gain), "context").collect()
    letters = learned.agg(F.count_distinct("next")).first()[0]
    contexts: dict[str, tuple[dict[str, int], dict[str, int]]] = {}
    for r in table:
        contexts.setdefault(r["context"], ({}, {}))[r["rejected"]][r["next"]] = r["n"]
    root = contexts.get("", ({}, {}))
    if not root[0] or not root[1]:
        return None
    model = Model(order, contexts, letters + 1)
    # Calibration on bins of the score: the driver sees a bounded histogram.
    judged = scored(rows.where(held_out), "url", model)
    bins = judged.groupBy(F.round(F.col("score") * 200).cast("int").alias("bin")).agg(
        F.sum(F.when(F.col("rejected"), 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("rejected"), 0).otherwise(1)).alias("good")).collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    best, lost, caught = math.inf, 0, 0
    for r in sorted(bins, key=lambda r: r["bin"]):
        # A threshold below this bin rejects what lies under it.
        error = lost / max(good, 1) + (bad - caught) / max(bad, 1)
        if error < best - 1e-12:
            best, model.threshold = error, (r["bin"] - 0.5) / 200
            model.errors = lost / max(good, 1), (bad - caught) / max(bad, 1)
        lost, caught = lost + r["good"], caught + r["bad"]
    return model


def scored(rows: DataFrame, url: str, model: Model | None) -> DataFrame:
    """Add ``score`` to the rows."""
    arrow_batches(rows.sparkSession)
    names = rows.columns
    at = names.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            urls = batch.column(at).to_pylist()
            values = [score(u or "", model, tables) for u in urls] if model else [0.0] * len(urls)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*names, "score"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{columns}, score double")


def judge(pages: DataFrame, rules: list[Rule], known: DataFrame | None = None, id: str = "page_id", url: str = "url", order: int = 4) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score.

    ``known`` has (url, accepted); by default the URLs that the rules decide.
    """
    held = pages.select(F.col(id), F.col(url).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    held = held.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)) if rules else held.withColumn("_rule", F.lit(None).cast("struct<rule:string,verdict:string>"))
    held = stored(held.select(id, "url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("given")))
    if known is None:
        known = held.where(F.col("given").isNotNull()).select("url", (F.col("given") == ACCEPT).alias("accepted"))
    model = fit(known, order)
    limit = model.threshold if model else -math.inf
    said = F.when(F.col("score") >= F.lit(limit), F.lit(ACCEPT)).otherwise(F.lit(REJECT))
    return scored(held, "url", model).select(id, "host", "path", "rule", F.coalesce("given", said).alias("verdict"), "score")
