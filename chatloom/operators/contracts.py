"""Data contracts: every rule is a boolean column, violations are counted in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom import banks
from chatloom.functions import schemas, text as T


def violations(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``(rule, n_violations, n_rows)``; a rule that is null counts as violated."""
    bad = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_r{i}") for i, ok in enumerate(rules.values())],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_r{i}").alias("n_violations")) for i, n in enumerate(rules)])
    return bad.select(*by, "n_rows", F.explode(rows).alias("r")).select(*by, "r.rule", "r.n_violations", "n_rows")


def violating_rows(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """``(key, rule)`` of every broken rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def required(*cols: str) -> dict[str, Column]:
    return {f"{c} required": F.col(c).isNotNull() for c in cols}


def one_of(c: str, values: Sequence[str], optional: bool = True) -> dict[str, Column]:
    ok = F.col(c).isin(list(values))
    return {f"{c} enum": (ok | F.col(c).isNull()) if optional else ok}


def within(c: str, lo: float | None = None, hi: float | None = None) -> dict[str, Column]:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col(c) >= lo)
    if hi is not None:
        ok = ok & (F.col(c) <= hi)
    return {f"{c} range": ok | F.col(c).isNull()}


def item_rules() -> dict[str, Column]:
    """Shape of summary items (flattened column names)."""
    rules = required("item_id", "slug", "title", "is_durable_project", "archetype", "domain", "goal",
                     "source_conversation_ids", "archetype_fields")
    rules |= one_of("cognitive_type", banks.COGNITIVE_TYPES) | one_of("verifiability_class", banks.VERIFIABILITY_CLASSES)
    rules |= one_of("modality", banks.MODALITIES) | one_of("tier", [t[0] for t in banks.DIFFICULTY_TIERS])
    rules |= within("confidence", 0, 1) | within("difficulty_score", 0, 12)
    for axis in ("steps", "specialisation", "ambiguity", "context_load"):
        rules |= within(axis, 0, 3)
    rules["objectives text"] = F.forall("objectives", lambda o: o["text"].isNotNull())
    rules["objectives role"] = F.forall("objectives", lambda o: o["role"].isNull() | o["role"].isin(banks.OBJECTIVE_ROLES))
    return rules


def missing_contract_keys(items: DataFrame, key: str = "slug") -> DataFrame:
    """``(key, field)`` that a valid item of its archetype must have and its open fields lack."""
    demanded = [(a, f) for a, f, _ in banks.FIELD_CONTRACT if (a, f) not in banks.OPTIONAL_FIELDS]
    bank = F.broadcast(items.sparkSession.createDataFrame(demanded, "archetype string, field string"))
    return (
        items.join(bank, "archetype")
        .where(~F.coalesce(F.map_contains_key("archetype_fields", F.col("field")), F.lit(False)))
        .select(key, "field")
    )


def with_contract_defaults(items: DataFrame) -> DataFrame:
    """Items whose open fields hold every key of the contract (empty text or ``[]`` where missing)."""
    contract: dict[str, list[Column]] = {}
    for arch, field, is_list in banks.FIELD_CONTRACT:
        contract.setdefault(arch, []).extend([F.lit(field), F.lit("[]" if is_list else "")])
    empty = F.create_map().cast("map<string,string>")
    defaults = empty
    for arch, pairs in contract.items():
        defaults = F.when(F.col("archetype") == arch, F.create_map(*pairs)).otherwise(defaults)
    have = F.map_filter(F.coalesce("archetype_fields", empty), lambda _, v: v.isNotNull() & (v != ""))
    rest = F.map_filter("_d", lambda k, _: ~F.map_contains_key("_h", k))
    blank = F.map_filter(
        F.coalesce("archetype_fields", empty),
        lambda k, v: (v.isNull() | (v == "")) & ~F.map_contains_key("_d", k),
    )
    return (
        items.withColumn("_d", defaults)
        .withColumn("_h", have)
        .withColumn("archetype_fields", F.map_concat("_h", rest, blank))
        .drop("_d", "_h")
    )


def benchmark_rules(pcts: Sequence[str], rates: Sequence[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c in pcts:
        out |= within(c, 0, 100)
    for c in rates:
        out |= within(c, 0)
    return out


def telemetry_rules() -> dict[str, Column]:
    """Shape of a telemetry summary: counts are not negative, min <= avg <= peak, known limits."""
    out = required("n_samples") | within("n_samples", 0) | within("duration_s", 0)
    for m in banks.TELEMETRY_METRICS:
        lo, mid, hi = (F.col(f"{m}_{s}") for s in ("min", "avg", "peak"))
        out[f"{m} order"] = mid.isNull() | ((lo <= mid + 0.005) & (mid <= hi + 0.005))
    return out


def entity_rules() -> dict[str, Column]:
    return required("version", "mentions", "n_chats") | within("mentions", 0) | within("unstable_votes", 0)


def state_rules() -> dict[str, Column]:
    token = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"
    roles = ["baseline", "pre_pass", "checkpoint", "post_pass", "evaluation_snapshot"]
    out = {f"{c} token": F.col(c).rlike(token) for c in ("state_id", "project_ref", "geometry_id")}
    out["schema_version"] = F.col("schema_version") == "1.0.0"
    out |= within("geometry_version", 1) | one_of("observation_role", roles, optional=False) | required("observed_at")
    return out


def state_schema() -> dict:
    """Project-state documents as nested schema: the rules of ``state_rules`` and a list of observations."""
    token = {"type": "string", "pattern": r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"}
    share = {"type": ["number", "null"], "minimum": 0, "maximum": 1}
    return {
        "type": "object",
        "required": ["schema_version", "state_id", "project_ref", "geometry_id", "geometry_version", "observation_role", "observed_at", "observations"],
        "additionalProperties": False,
        "properties": {
            "schema_version": {"type": "string", "enum": ["1.0.0"]}, "state_id": token, "project_ref": token, "geometry_id": token,
            "geometry_version": {"type": "integer", "minimum": 1},
            "observation_role": {"type": "string", "enum": ["baseline", "pre_pass", "checkpoint", "post_pass", "evaluation_snapshot"]},
            "observed_at": {"type": "string"},
            "observations": {
                "type": "array", "minItems": 1,
                "items": {"type": "object", "required": ["coordinate"], "properties": {"coordinate": token, "value": share, "evidence": {"type": "array", "items": {"type": "string"}}}},
            },
        },
    }


def telemetry_schema() -> dict:
    """Telemetry summaries as nested schema: counts, and a lowest, mean and highest value of each metric."""
    metric = {"type": ["object", "null"], "required": ["min", "avg", "peak"], "properties": {k: {"type": ["number", "null"]} for k in ("min", "avg", "peak")}}
    return {
        "type": "object", "required": ["n_samples"],
        "properties": {
            "n_samples": {"type": "integer", "minimum": 0}, "duration_s": {"type": ["number", "null"], "minimum": 0}, "throttled": {"type": ["boolean", "null"]},
            "metrics": {"type": "object", "properties": {m: metric for m in banks.TELEMETRY_METRICS}},
        },
    }


def document_faults(docs: DataFrame, key: str, document: str, schema: Mapping) -> DataFrame:
    """``(key, fault)`` of JSON documents: every path at fault with its rule; ``$: json`` for a text that is none."""
    v = F.try_parse_json(document)
    found = T.let(v, lambda x: schemas.faults(x, schema))
    return docs.select(key, F.explode(F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(found)).alias("fault"))


def dangling(rows: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose reference is not in the dimension."""
    known = dim.select(F.col(dim_key).alias(key)).distinct()
    return rows.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def tier_gaps(tiers: DataFrame, lo: int = 0, hi: int = 12) -> DataFrame:
    """Scores of the range that no tier, or more than one tier, covers."""
    covered = tiers.select("tier", F.explode(F.sequence("lo", "hi")).alias("score"))
    wanted = tiers.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("score"))
    n = covered.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "score", "left").where(F.coalesce("n", F.lit(0)) != 1).select("score", F.coalesce("n", F.lit(0)).alias("n_tiers"))


def bank_rules() -> dict[str, Column]:
    """Model bank entries: name and provider given, a skipped entry says why."""
    out = {"name given": F.length("name") > 0, "provider given": F.length("provider") > 0}
    out["skip needs a reason"] = ~F.coalesce("skip", F.lit(False)) | F.col("skip_reason").isNotNull()
    out["subscription needs a plan"] = (F.col("billing_kind") != "subscription") | F.col("plan_id").isNotNull()
    return out
