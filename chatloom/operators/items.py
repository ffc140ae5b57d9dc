"""Model answers to clean items: recovery, cleaning, merging, batching."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as ty

from chatloom import banks
from chatloom.functions import text as T
from chatloom.plans.batches import next_fit

BATCH_ITEM_OVERHEAD = 200
Complete = Callable[[str, str], tuple[str, dict]]


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column, prefix: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(prefix), F.lit(False))


def recover_object(raw: Column) -> Column:
    """JSON object of an answer: the whole text, else its outermost braces, else null."""
    whole = F.try_parse_json(raw)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))
    found = F.when(whole.isNotNull(), whole).otherwise(inner)
    return F.when(_kind(found, "OBJECT<"), found)


def text_of(v: Column) -> Column:
    """Stripped text of a text field, else null (blank counts as missing)."""
    return F.when(_kind(v, "STRING"), T.nonblank(F.try_variant_get(v, "$", "string")))


def _objects(v: Column) -> Column:
    listed = F.when(_kind(v, "ARRAY<"), F.try_variant_get(v, "$", "array<variant>"))
    return F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda x: _kind(x, "OBJECT<"))


def _clean(v: Column, must: str, **optional: Callable[[Column], Column]) -> Column:
    """Structs of the list's objects that carry the required text field."""
    rows = F.transform(
        _objects(v),
        lambda o: F.struct(
            text_of(_get(o, f"$.{must}")).alias(must), *[fn(o).alias(n) for n, fn in optional.items()]
        ),
    )
    return F.filter(rows, lambda r: r[must].isNotNull())


def _enum(name: str, allowed: list[str]) -> Callable[[Column], Column]:
    def pick(o: Column) -> Column:
        low = F.lower(text_of(_get(o, f"$.{name}")))
        return F.when(low.isin(allowed), low)

    return pick


def _text(name: str) -> Callable[[Column], Column]:
    return lambda o: text_of(_get(o, f"$.{name}"))


def clean_objectives(v: Column) -> Column:
    return _clean(v, "text", role=_enum("role", banks.OBJECTIVE_ROLES))


def clean_deliveries(v: Column) -> Column:
    return _clean(v, "name", materiality=_enum("materiality", banks.DELIVERY_MATERIALITY), kind=_text("kind"))


def clean_evolution(v: Column) -> Column:
    return _clean(v, "change", date=_text("date"))


def clean_secondary(v: Column) -> Column:
    return _clean(v, "id", distinct_contribution=_text("distinct_contribution"))


def clean_domain_pairs(v: Column) -> Column:
    return _clean(
        v, "domain", subdomain=_text("subdomain"), rationale=_text("rationale"),
        distinct_contribution=_text("distinct_contribution"),
    )


def clean_requirements(v: Column) -> Column:
    listed = F.when(_kind(v, "ARRAY<"), F.try_variant_get(v, "$", "array<variant>"))
    texts = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), text_of)
    return F.filter(texts, lambda t: t.isNotNull())


def clamp_confidence(v: Column) -> Column:
    """Number in [0, 1]; anything unreadable is 0."""
    n = v.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def raw_shape_ok(v: Column) -> Column:
    """Did the raw answer already have the core shape, before any cleaning?"""
    listy = lambda k: _get(v, f"$.{k}").isNull() | _kind(_get(v, f"$.{k}"), "ARRAY<")
    fields = _get(v, "$.archetype_fields")
    ok = (
        _kind(v, "OBJECT<")
        & text_of(_get(v, "$.primary_archetype.id")).isNotNull()
        & text_of(_get(v, "$.primary_domain_pair.domain")).isNotNull()
        & _kind(_get(v, "$.goal"), "STRING")
        & listy("objectives")
        & listy("requirements")
        & (fields.isNull() | _kind(fields, "OBJECT<"))
    )
    return F.coalesce(ok, F.lit(False))


def build_items(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Items of clusters: the model owns the meaning, the facts come from the cluster.

    ``answers``: slug, answer, usd, bundle_sha. ``clusters``: slug, facts and the
    prior (archetype, domain, subdomain). A failed answer falls back to the prior
    and says so.
    """
    parsed = answers.select("slug", "usd", "bundle_sha", recover_object(F.col("answer")).alias("v"))
    v = F.col("v")
    g = lambda path: _get(v, f"$.{path}")
    either = lambda path, prior: F.coalesce(text_of(g(path)), prior)
    blank = F.lit("")
    has_pair = _kind(g("primary_domain_pair"), "OBJECT<") & (F.to_json(g("primary_domain_pair")) != "{}")
    fields = F.when(
        _kind(g("archetype_fields"), "OBJECT<"), F.from_json(F.to_json(g("archetype_fields")), "map<string,string>")
    )
    durable = F.coalesce(F.try_variant_get(v, "$.is_durable_project", "boolean"), F.coalesce("n_versions", F.lit(0)) >= 1)
    items = clusters.withColumnsRenamed({"archetype": "_pa", "domain": "_pd", "subdomain": "_ps"}).join(parsed, "slug")
    return items.select(
        F.col("slug").alias("item_id"),
        "slug",
        either("title", F.col("slug")).alias("title"),
        either("description", blank).alias("description"),
        durable.alias("is_durable_project"),
        either("primary_archetype.id", F.col("_pa")).alias("archetype"),
        either("primary_archetype.rationale", blank).alias("archetype_rationale"),
        clean_secondary(g("secondary_archetypes")).alias("secondary_archetypes"),
        F.coalesce(
            F.when(has_pair, text_of(g("primary_domain_pair.domain"))).otherwise(F.col("_pd")), F.lit("general_knowledge")
        ).alias("domain"),
        F.when(has_pair, text_of(g("primary_domain_pair.subdomain"))).otherwise(F.col("_ps")).alias("subdomain"),
        clean_domain_pairs(g("secondary_domain_pairs")).alias("secondary_domain_pairs"),
        clamp_confidence(F.try_variant_get(v, "$.confidence", "string")).alias("confidence"),
        either("goal", blank).alias("goal"),
        clean_objectives(g("objectives")).alias("objectives"),
        clean_requirements(g("requirements")).alias("requirements"),
        clean_evolution(g("requirements_evolution")).alias("requirements_evolution"),
        clean_deliveries(g("deliveries")).alias("deliveries"),
        F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("archetype_fields"),
        *[c for c in clusters.columns if c not in ("slug", "archetype", "domain", "subdomain")],
        F.round("usd", 6).alias("cost_usd"),
        "bundle_sha",
        v.isNotNull().alias("llm_ok"),
        F.when(v.isNotNull(), F.lit("llm")).otherwise(F.lit("deterministic_prior")).alias("classification_source"),
        raw_shape_ok(v).alias("schema_valid"),
    )


# --- calls ----------------------------------------------------------------


def _object(text: str) -> bool:
    for candidate in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            return isinstance(json.loads(candidate), dict)
        except ValueError:
            continue
    return False


def complete(prompts: DataFrame, fn: Complete, system: str = "", retries: int = 1) -> DataFrame:
    """Call a user-supplied model per prompt: adds answer, in_tok, out_tok, load_ms, attempts, error.

    A reply that holds no JSON object is asked again up to ``retries`` times;
    tokens of all attempts are counted. An exception ends the attempts.
    """
    added = [("answer", ty.StringType()), ("in_tok", ty.LongType()), ("out_tok", ty.LongType()),
             ("load_ms", ty.DoubleType()), ("attempts", ty.LongType()), ("error", ty.StringType())]
    schema = ty.StructType([*prompts.schema.fields, *[ty.StructField(n, t) for n, t in added]])

    def one(prompt: str) -> tuple:
        used = {"in_tok": 0, "out_tok": 0, "load_ms": 0.0}
        answer, error, tries = None, None, 0
        while tries <= max(retries, 0):
            tries += 1
            try:
                text, usage = fn(system, prompt)
            except Exception as exc:  # the caller's model may raise anything
                error = str(exc)
                break
            for k in used:
                used[k] += usage.get(k, 0)
            if _object(text):
                answer = text
                break
        return answer, used["in_tok"], used["out_tok"], float(used["load_ms"]), tries, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = pd.DataFrame([one(p) for p in frame["prompt"]], columns=[n for n, _ in added], index=frame.index)
            yield pd.concat([frame, got], axis=1)

    return prompts.mapInPandas(run, schema)


def pack_batches(
    work: DataFrame, run: Sequence[str], order: Sequence[str], chars: str, size: int, max_chars: int, head_chars: int = 0
) -> DataFrame:
    """Exact next-fit batches along the order of each run: a batch closes at ``size`` items or ``max_chars``.

    A single item over the budget is a batch of its own. A run of any length spreads over tasks.
    """
    return next_fit(work, run, order, F.col(chars) + BATCH_ITEM_OVERHEAD, size, max_chars - head_chars)


def split_batch(answers: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable per-slug objects of batched answers, and the slugs that need a call of their own.

    ``answers``: batch, answer. ``members``: batch, slug.
    """
    objects = (
        answers.select("batch", F.from_json(F.to_json(recover_object(F.col("answer"))), "map<string,string>").alias("m"))
        .select("batch", F.explode("m").alias("slug", "answer"))
        .where(_kind(F.try_parse_json("answer"), "OBJECT<"))
    )
    usable = members.join(objects, ["batch", "slug"])
    return usable, members.join(usable.select("batch", "slug"), ["batch", "slug"], "left_anti")


# --- recovered answers ----------------------------------------------------


def rollout_answers(lines: DataFrame, slug_regex: str) -> DataFrame:
    """``(file, slug, answer)`` from session logs.

    ``lines``: file, line_no, value (JSON). The slug comes from the last user
    message that names one, the answer is the last assistant message.
    """
    v = F.try_parse_json("value")
    content = _get(v, "$.payload.content")
    parts = F.transform(
        F.filter(
            F.coalesce(F.when(_kind(content, "ARRAY<"), F.try_variant_get(content, "$", "array<variant>")), F.array().cast("array<variant>")),
            lambda p: _kind(p, "OBJECT<"),
        ),
        lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")),
    )
    text = F.when(_kind(content, "ARRAY<"), F.array_join(parts, " ")).otherwise(
        F.coalesce(F.when(_kind(content, "STRING"), F.try_variant_get(content, "$", "string")), F.lit(""))
    )
    rows = lines.select(
        "file", "line_no", F.try_variant_get(v, "$.type", "string").alias("type"),
        F.try_variant_get(v, "$.payload.role", "string").alias("role"), text.alias("text"),
    ).where("type = 'response_item'")
    slug = F.nullif(F.regexp_extract("text", slug_regex, 1), F.lit(""))
    named = F.when(F.col("role") == "user", slug)
    said = (F.col("role") == "assistant") & (T.strip(F.col("text")) != "")
    return (
        rows.groupBy("file")
        .agg(
            F.max(F.when(named.isNotNull(), F.struct("line_no", named.alias("slug"))))["slug"].alias("slug"),
            F.max(F.when(said, F.struct("line_no", "text")))["text"].alias("answer"),
        )
        .where("slug IS NOT NULL AND answer IS NOT NULL")
    )


def recovered(answers: DataFrame, file_times: DataFrame, clusters: DataFrame, bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newest usable answer per slug that has a cluster and a bundle; and the slugs without a bundle."""
    usable = answers.where(recover_object(F.col("answer")).isNotNull()).join(file_times, "file")
    last = usable.groupBy("slug").agg(F.max_by("answer", F.struct("mtime", "file")).alias("answer"))
    known = last.join(clusters.select("slug"), "slug", "left_semi")
    return known.join(bundles.select("slug", "bundle_sha"), "slug"), known.join(bundles, "slug", "left_anti")
