"""Transparent rule classification of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatloom import banks


def tiers(spark) -> DataFrame:
    return spark.createDataFrame(banks.DIFFICULTY_TIERS, "tier string, weight int, lo int, hi int")


def tier_of(score: Column) -> Column:
    """Difficulty tier of a 0-12 score; scores outside every range count as the hardest."""
    out = F.lit(banks.DIFFICULTY_TIERS[-1][0])
    for tier, _, lo, hi in reversed(banks.DIFFICULTY_TIERS):
        out = F.when(score.between(lo, hi), F.lit(tier)).otherwise(out)
    return out


def tier_weight(tier: Column) -> Column:
    out = F.lit(1)
    for name, weight, _, _ in banks.DIFFICULTY_TIERS:
        out = F.when(tier == name, F.lit(weight)).otherwise(out)
    return out


def structural_points(c: dict[str, Column]) -> list[tuple[str, float, Column]]:
    """``(archetype, points, condition)`` of the structural rules, in scoring order.

    ``c`` names the columns: n_versions, has_code, has_image, n_code, n_data,
    n_files, n_conv and the file-name flags.
    """
    none = c["n_versions"] == 0
    plain = (c["n_files"] == 0) & none & ~c["has_image"]
    return [
        ("software_app", 3.0, c["n_versions"] >= 2),
        ("software_app", 1.0, c["n_versions"] == 1),
        ("automation_or_diagnostic_script", 0.5, c["n_versions"] == 1),
        ("runtime_package", 2.0, c["f_setup"] | c["f_pyproject"] | c["f_package"]),
        ("ai_agent_prompt", 2.5, c["f_skill"]),
        ("controlled_spec_or_schema", 1.0, c["f_json"] | c["f_schema"] | c["f_glossary"]),
        ("media_generation", 3.0, c["has_image"] & ~c["has_code"] & none),
        ("automation_or_diagnostic_script", 1.0, (c["n_code"] >= 1) & none & (c["n_code"] <= 3)),
        ("data_extraction_processing", 1.0, c["n_data"] >= 2),
        ("knowledge_qa", 1.0, plain),
        ("advisory_troubleshooting", 0.5, plain & (c["n_conv"] == 1)),
    ]


#: Words that any bank lists.
BANK_WORDS = sorted({w for ws in banks.ARCHETYPE_KEYWORDS.values() for w in ws} | {w for _, _, ws in banks.DOMAIN_KEYWORDS for w in ws})


def bank_words(words: Column) -> Column:
    """The distinct words of an array that any bank lists."""
    return F.array_intersect(words, F.array(*[F.lit(w) for w in BANK_WORDS]))


def _hits(words: Column, c: dict[str, Column]) -> Column:
    """Everything that scores: (archetype, points, seq) of structural rules and of listed words."""
    rules = structural_points(c)
    row = lambda a, p, i: F.struct(F.lit(a).alias("archetype"), F.lit(p).alias("points"), F.lit(i).alias("seq"))
    structural = F.filter(F.array(*[F.when(cond, row(a, p, i)) for i, (a, p, cond) in enumerate(rules)]), lambda x: x.isNotNull())
    bank = F.array(*[
        F.struct(F.lit(word).alias("word"), row(arch, 0.8, len(rules) + i).alias("hit"))
        for i, (arch, listed) in enumerate(banks.ARCHETYPE_KEYWORDS.items())
        for word in listed
    ])
    return F.concat(structural, F.transform(F.filter(bank, lambda b: F.array_contains(words, b["word"])), lambda b: b["hit"]))


def _top(hits: Column, c: dict[str, Column]) -> Column:
    """Up to three archetypes by score, the first hit first on ties; a fallback where nothing scores."""
    names = sorted({a for a, _, _ in structural_points(c)} | set(banks.ARCHETYPE_KEYWORDS))

    def summed(name: Column) -> Column:
        own = F.filter(hits, lambda h: h["archetype"] == name)
        score = F.round(F.aggregate(own, F.lit(0.0), lambda s, h: s + h["points"]), 2)
        return F.struct((-score).alias("neg"), F.array_min(F.transform(own, lambda h: h["seq"])).alias("seq"), name.alias("archetype"), score.alias("score"))

    scored = F.filter(F.transform(F.array(*[F.lit(n) for n in names]), summed), lambda x: x["seq"].isNotNull())
    bare = F.array(F.struct(F.lit(-0.5).alias("neg"), F.lit(0).alias("seq"), F.lit("knowledge_qa").alias("archetype"), F.lit(0.5).alias("score")))
    return F.slice(F.array_sort(F.when(F.size(hits) > 0, scored).otherwise(bare)), 1, 3)


def _domain(words: Column, coded: Column) -> Column:
    """Domain pair with most listed words; software for coded clusters, else general knowledge."""
    bank = F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(d).alias("domain"), F.lit(s).cast("string").alias("subdomain"), F.array(*[F.lit(w) for w in listed]).alias("listed"))
        for i, (d, s, listed) in enumerate(banks.DOMAIN_KEYWORDS)
    ])
    counted = F.transform(bank, lambda b: F.struct((-F.size(F.array_intersect(words, b["listed"]))).alias("neg"), b["seq"].alias("seq"), b["domain"].alias("domain"), b["subdomain"].alias("subdomain")))
    best = F.array_min(F.filter(counted, lambda x: x["neg"] < 0))
    default = F.when(coded, F.lit("software_engineering")).otherwise(F.lit("general_knowledge"))
    return F.struct(F.coalesce(best["domain"], default).alias("domain"), best["subdomain"].alias("subdomain"))


def classified(clusters: DataFrame, words: str, c: dict[str, Column], coded: Column) -> DataFrame:
    """Add ``top`` (array of archetype, score; best first), ``domain`` and ``subdomain`` to each row.

    All of it is worked out inside the row: no shuffle, whatever the number of rows
    or words. ``words`` holds the row's listed words (see ``bank_words``).
    """
    rows = clusters.select("*", _hits(F.col(words), c).alias("_hits"), _domain(F.col(words), coded).alias("_domain"))
    return rows.select(*clusters.columns, _top(F.col("_hits"), c).alias("top"), "_domain.domain", "_domain.subdomain")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Primary archetype and up to two secondary ones (rank 1 to 3), one row each."""
    # The outer form adds no filter on the list, which would work it out a second time.
    return rows.select(key, F.posexplode_outer("top").alias("rank", "t")).select(key, "t.archetype", "t.score", (F.col("rank") + 1).alias("rank"))


def facets(archetype: Column, domain: Column, c: dict[str, Column]) -> dict[str, Column]:
    """Prior cognitive type, difficulty axes and tier, verifiability and modality."""
    cognitive = F.lit("retrieve")
    for name, kind in banks.ARCHETYPE_COGNITIVE.items():
        cognitive = F.when(archetype == name, F.lit(kind)).otherwise(cognitive)
    verify = F.lit("rubric")
    for kind, v in banks.COGNITIVE_VERIFIABILITY.items():
        verify = F.when(cognitive == kind, F.lit(v)).otherwise(verify)
    verify = F.when((domain == "arts_creative") | (archetype == "media_generation"), F.lit("subjective")).otherwise(verify)

    nv, nc = c["n_versions"], c["n_conv"]
    base_steps = F.when(c["has_code"] | (nv >= 2), 2).when(nv == 1, 1).otherwise(0)
    steps = F.least(F.lit(3), base_steps + F.when(cognitive == "reason_analyze", 1).otherwise(0))
    special = F.when(domain.isin(banks.SPECIALIZED_DOMAINS), 2).when(
        domain.isin("general_knowledge", "personal_productivity"), 0
    ).otherwise(1)
    open_ended = ["converse_advise", "generate_create", "plan_strategize", "explain"]
    ambiguity = F.when(cognitive.isin(open_ended), 2).otherwise(1)
    load = F.least(
        F.lit(3), F.when(nc >= 4, 2).when(nc >= 2, 1).otherwise(0) + F.when(nv >= 2, 1).otherwise(0)
    )
    score = steps + special + ambiguity + load
    code, image, data = c["has_code"], c["has_image"], c["n_data"]
    modality = (
        F.when(image & ~code, F.when(data >= 1, "mixed").otherwise("image"))
        .when(code, F.when(image | (data >= 2), "mixed").otherwise("code"))
        .when(data >= 2, "data")
        .otherwise("text")
    )
    return {
        "cognitive_type": cognitive,
        "steps": steps,
        "specialisation": special,
        "ambiguity": ambiguity,
        "context_load": load,
        "difficulty_score": score,
        "tier": tier_of(score),
        "verifiability_class": verify,
        "modality": modality,
    }


def prior(clusters: DataFrame, keywords: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Classification prior of ``clusters.roll_up`` rows."""
    c = {n: F.col(n) for n in ("n_versions", "n_code", "n_data", "n_files", "has_code", "f_setup", "f_pyproject",
                               "f_package", "f_skill", "f_json", "f_schema", "f_glossary")}
    c |= {"has_image": F.col("has_image_asset"), "n_conv": F.col("n_conversations")}
    # As many words per cluster as the banks list, at most.
    listed = F.broadcast(clusters.sparkSession.createDataFrame([(w,) for w in BANK_WORDS], "keyword string"))
    words = keywords.join(listed, "keyword").groupBy(key).agg(F.collect_set("keyword").alias("_words"))
    have = clusters.join(words, key, "left").withColumn("_words", F.coalesce("_words", F.array().cast("array<string>")))
    rows = classified(have, "_words", c, c["has_code"] | (c["n_versions"] >= 1))
    first = F.element_at("top", 1)
    rest = F.transform(F.slice("top", 2, 2), lambda t, i: F.struct((i + 2).alias("rank"), t["archetype"].alias("archetype"), t["score"].alias("score")))
    wide = rows.select(*clusters.columns, first["archetype"].alias("archetype"), first["score"].alias("archetype_score"), rest.alias("secondary"), "domain", "subdomain")
    shown = facets(F.col("archetype"), F.col("domain"), c)
    return wide.select("*", *[v.alias(k) for k, v in shown.items()])
