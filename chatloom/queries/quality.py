"""Queries over ``labels`` and ``documents``: quality, accuracy and run comparison.

A source is a model and a document an item. Good quality means a completed item,
not toxic a schema-valid one; line counts stand in for list fields.
"""

from pyspark.sql import functions as F

from chatloom.operators import evaluation, quality
from chatloom.queries.base import Tables, query


def _items(t: Tables):
    lines = F.split("text", "\n")
    return t.labels.join(t.documents, "doc_id").select(
        F.col("source").alias("model"), F.col("doc_id").alias("slug"), (F.col("quality") == 1).alias("llm_ok"),
        F.lit(None).cast("string").alias("classification_source"), (F.col("toxic") == 0).alias("schema_valid"),
        F.when(F.col("n_chars") > 500, F.lit("goal")).otherwise(F.lit(" ")).alias("goal"),
        lines.alias("objectives"), F.filter(lines, lambda x: F.length(x) > 100).alias("requirements"),
        F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.when(F.col("n_chars") > 2000, "x").otherwise("[]")).alias("archetype_fields"),
        F.col("lang"), "n_chars", "quality", "toxic",
    )


_SQL_ITEMS = """
i AS (SELECT source AS model, doc_id AS slug, quality = 1 AS success, toxic = 0 AS schema_ok, (n_chars > 500)::INT AS g,
        least(len(string_split(text, E'\\n')), 3) / 3.0::DOUBLE AS o, least(len(list_filter(string_split(text, E'\\n'), lambda x: length(x) > 100)), 3) / 3.0::DOUBLE AS r,
        CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.5 END::DOUBLE AS a, lang, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id))"""
_AVG = "coalesce(avg({0}) FILTER (success), 0)"


@query(
    f"""WITH {_SQL_ITEMS}
    SELECT model, round_even(avg(success::INT) * 100, 0) AS completion_pct,
      round({_AVG.format('g')} * 100, 4) AS goal, round({_AVG.format('o')} * 100, 4) AS objectives, round({_AVG.format('r')} * 100, 4) AS requirements,
      round({_AVG.format('a')} * 100, 4) AS fields, round_even(avg(schema_ok::INT) * 100, 0) AS schema_valid_pct,
      count(*) FILTER (success) AS completed, count(*) AS n_items FROM i GROUP BY model"""
)
def quality_axes(t: Tables):
    """Reliability and unrounded depth axes per model."""
    rows = quality.measured(_items(t))
    on = lambda c, n: F.round(F.coalesce(F.avg(F.when(F.col("success"), F.col(c))), F.lit(0.0)) * 100, 4).alias(n)
    return rows.groupBy("model").agg(
        quality.pct(F.avg(F.col("success").cast("int"))).alias("completion_pct"), on("q_goal", "goal"), on("q_objectives", "objectives"),
        on("q_requirements", "requirements"), on("q_fields", "fields"), quality.pct(F.avg(F.col("schema_ok").cast("int"))).alias("schema_valid_pct"),
        F.count_if("success").alias("completed"), F.count(F.lit(1)).alias("n_items"),
    )


@query(
    f"""WITH {_SQL_ITEMS}
    SELECT model, round_even(avg(success::INT) * 100, 0) AS completion_pct, round_even({_AVG.format('g')} * 100, 0) AS goal_pct,
      round_even(avg(schema_ok::INT) * 100, 0) AS schema_valid_pct, count(*) FILTER (success) AS completed, count(*) AS n_items
    FROM i GROUP BY model"""
)
def quality_rows(t: Tables):
    """Leaderboard rows, most reliable first."""
    rows = quality.quality_rows(quality.measured(_items(t)), ["model"]).orderBy(*quality.quality_order(), "model")
    return rows.select("model", "completion_pct", "goal_pct", "schema_valid_pct", "completed", "n_items")


@query(
    f"""WITH {_SQL_ITEMS}, d AS (SELECT model, lang AS slug, success, row_number() OVER (PARTITION BY model, lang ORDER BY slug) AS rn FROM i)
    SELECT model, count(*) AS n_items, count(*) FILTER (success) AS completed FROM d WHERE rn = 1 GROUP BY 1"""
)
def leaderboard_first_wins(t: Tables):
    """Items repeated over files count once per model, in file order (the language is the item)."""
    rows = _items(t).withColumn("file", F.col("slug")).withColumn("pos", F.lit(0)).withColumn("slug", F.col("lang"))
    rows = rows.withColumn("doc_source", F.lit(None).cast("string"))
    return quality.leaderboard(rows).select("model", "n_items", "completed")


_SQL_GRADED = f"""{_SQL_ITEMS},
gr AS (SELECT model, slug, lang, (toxic = 1 - quality)::INT AS correct, CASE WHEN n_chars < 800 THEN 'T1' WHEN n_chars < 2000 THEN 'T2' WHEN n_chars < 5000 THEN 'T3' ELSE 'T4' END AS tier
       FROM i WHERE success)"""


def _graded(t: Tables):
    rows = quality.measured(_items(t)).withColumn("domain", F.col("lang"))
    ref = quality.reference_key(rows.withColumn("archetype", F.col("quality").cast("string")))
    mine = rows.withColumn("archetype", (1 - F.col("toxic")).cast("string"))
    n = F.col("n_chars")
    tier = F.when(n < 800, "T1").when(n < 2000, "T2").when(n < 5000, "T3").otherwise("T4")
    kind = F.when(F.col("lang") == "fr", "subjective").otherwise("objective")
    return quality.graded(mine, ref).withColumn("tier", tier).withColumn("verifiability_class", kind)


@query(f"WITH {_SQL_GRADED} SELECT model, round_even(avg(correct) * 100, 0) AS accuracy_pct, count(*) AS accuracy_n FROM gr GROUP BY 1")
def accuracy_vs_reference(t: Tables):
    """Agreement of one label with the other as the answer key."""
    return quality.accuracy(_graded(t), ["model"])


@query(
    f"""WITH {_SQL_GRADED} SELECT model, round_even(sum(right(tier, 1)::INT * correct) / sum(right(tier, 1)::INT) * 100, 0) AS iq, count(*) AS n
    FROM gr WHERE lang <> 'fr' GROUP BY 1"""
)
def weighted_accuracy(t: Tables):
    return quality.weighted_accuracy(_graded(t), ["model"])


@query(
    f"""WITH {_SQL_GRADED} SELECT lang, round_even(avg(correct) FILTER (tier = 'T1') * 100, 0) AS T1, round_even(avg(correct) FILTER (tier = 'T2') * 100, 0) AS T2,
      round_even(avg(correct) FILTER (tier = 'T3') * 100, 0) AS T3, round_even(avg(correct) FILTER (tier = 'T4') * 100, 0) AS T4 FROM gr WHERE lang <> 'fr' GROUP BY 1"""
)
def accuracy_pivot(t: Tables):
    """Accuracy by language and difficulty."""
    long = quality.accuracy_by(_graded(t), ["lang"], "tier")
    return quality.pivot_cells(long, ["lang"], "tier", ["T1", "T2", "T3", "T4"])


def _sides(t: Tables):
    """Two runs over documents. The tables hold one: side a is made of the labels, side b of every document's language and length."""
    def side(df, arch, goal):
        return df.select(
            F.col("doc_id").alias("slug"), arch.alias("archetype"), F.col("lang").alias("domain"), goal.alias("goal"),
            F.size(F.split("text", "\n")).alias("n_objectives"), F.lit(1).alias("n_requirements"), F.col("n_chars").alias("desc_len"),
            F.lit(0.5).alias("af_fill"),
        )

    labelled = t.labels.join(t.documents, "doc_id")
    a = side(labelled, F.when(F.col("toxic") == 0, F.col("quality").cast("string")), F.when(F.col("quality") == 1, "g").otherwise(""))
    b = side(t.documents, F.when(F.col("lang") == "en", "1").otherwise("0"), F.when(F.col("n_chars") > 3000, "g").otherwise(" "))
    return quality.align(a, b)


_SQL_PAIRS = """
a AS (SELECT doc_id AS slug, CASE WHEN toxic = 0 THEN quality::VARCHAR END AS arch, lang, quality = 1 AS goal, n_chars FROM labels JOIN documents USING (doc_id)),
b AS (SELECT doc_id AS slug, CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS arch, lang, n_chars > 3000 AS goal, n_chars FROM documents),
p AS (SELECT coalesce(a.slug, b.slug) AS slug, a.slug IS NOT NULL AS ina, b.slug IS NOT NULL AS inb, a.arch AS aa, b.arch AS ba, a.lang AS al, b.lang AS bl,
        a.goal AS ag, b.goal AS bg, a.n_chars AS an FROM a FULL JOIN b ON a.slug = b.slug)"""


@query(
    f"""WITH {_SQL_PAIRS}
    SELECT count(*) FILTER (ina AND inb) AS n_overlap, count(*) FILTER (ina AND NOT inb) AS n_a_only, count(*) FILTER (inb AND NOT ina) AS n_b_only,
      count(*) FILTER (ina AND inb AND aa IS NOT NULL AND ba IS NOT NULL) AS n_both_classified, count(*) FILTER (ina AND inb AND aa <> ba) AS n_archetype_diffs,
      round(avg((aa = ba)::INT) FILTER (ina AND inb AND aa IS NOT NULL), 6) AS archetype_agree_rate, round(avg((al = bl)::INT) FILTER (ina AND inb), 6) AS domain_agree_rate,
      count(*) FILTER (ina AND inb AND ag AND bg) AS goal_both, count(*) FILTER (ina AND inb AND ag AND NOT bg) AS goal_a_only,
      count(*) FILTER (ina AND inb AND NOT ag AND bg) AS goal_b_only, round(avg(an) FILTER (ina AND inb), 4) AS a_avg_desc_len FROM p"""
)
def run_agreement(t: Tables):
    """Two runs matched on the item: overlap, agreement, head-to-head fill."""
    out = quality.compare(_sides(t))
    six = [F.round(c, 6).alias(c) for c in ("archetype_agree_rate", "domain_agree_rate")]
    return out.select(
        "n_overlap", "n_a_only", "n_b_only", "n_both_classified", "n_archetype_diffs", *six, "goal_both", "goal_a_only", "goal_b_only",
        F.round("a_avg_desc_len", 4).alias("a_avg_desc_len"),
    )


@query(f"WITH {_SQL_PAIRS} SELECT slug, aa AS a_archetype, ba AS b_archetype FROM p WHERE aa <> ba ORDER BY slug LIMIT 25")
def run_disagreements(t: Tables):
    return quality.disagreements(_sides(t))


@query(
    f"""WITH {_SQL_ITEMS} SELECT model, round(avg((n_chars > 500)::INT), 6) AS classified_rate,
      round(avg(((n_chars > 500)::INT + 1 + 2 * a) / 4), 6) AS fill_rate FROM i GROUP BY 1"""
)
def classified_rates(t: Tables):
    rows = _items(t).withColumn("archetype", F.col("lang")).withColumn("domain", F.col("lang"))
    out = quality.classified_rate(rows, ["model"])
    return out.select("model", F.round("classified_rate", 6).alias("classified_rate"), F.round("fill_rate", 6).alias("fill_rate"))


@query(
    f"""WITH {_SQL_ITEMS},
    s AS (SELECT 'src' || (user_id % 20) AS model, event_type, round(value * 100)::BIGINT AS secs FROM events),
    p AS (SELECT model, count(*) FILTER (event_type = 'purchase') AS ok, (sum(secs) FILTER (event_type = 'purchase'))::BIGINT AS secs FROM s GROUP BY 1 HAVING ok > 0),
    q AS (SELECT model, round_even(avg(success::INT) * 100, 0) AS completion_pct FROM i GROUP BY 1)
    SELECT coalesce(p.model, q.model) AS model, completion_pct, (secs / ok)::DOUBLE AS sec_per_item FROM p FULL JOIN q ON p.model = q.model"""
)
def arena(t: Tables):
    """Speed and quality of every model found in either table."""
    from chatloom.operators import perf

    model = F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)))
    zero = F.lit(0).cast("bigint")
    trace = t.events.select(
        model.alias("run_id"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("secs"),
        zero.alias("in_tok"), zero.alias("out_tok"), zero.alias("usd"), zero.alias("load_ms"),
    )
    speed = perf.model_speed(trace, ok="purchase", fail="error").select("model", "sec_per_item")
    qual = quality.quality_rows(quality.measured(_items(t)), ["model"]).select("model", "completion_pct")
    return speed.join(qual, "model", "full_outer")


# --- graded answers -------------------------------------------------------


@query(
    """WITH q AS (
      SELECT item_id AS id, ['refuse', 'contains_all', 'contains_any', 'version_equals'][item_id % 4 + 1] AS kind, item_id % 3 AS a, item_id % 5 AS e FROM benchmark),
    g AS (
      SELECT id, kind, CASE kind WHEN 'refuse' THEN a = 2 WHEN 'contains_all' THEN a = 0 WHEN 'contains_any' THEN a IN (0, 1) ELSE a = 1 END AS good, e,
        ['entity', 'rag', 'rag', 'rag', 'rag'][e + 1] AS route, (id * 37 % 100) * 100 AS elapsed_ms FROM q)
    SELECT id, kind AS grade_type, route, elapsed_ms::BIGINT AS elapsed_ms, e NOT IN (1, 2) AND good AS passed, id % 7 < 4 AS gold_hit,
      CASE WHEN e = 1 THEN TRUE WHEN e = 2 THEN elapsed_ms >= 5400 WHEN route = 'entity' THEN FALSE ELSE elapsed_ms > 6000 END AS unusable FROM g"""
)
def graded_answers(t: Tables):
    """Answers to every question graded by its kind, with gold hits, errors and late ones (questions are the benchmark's, answers written from their ids)."""
    i = F.col("item_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    gold = F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("g"), i.cast("string")), F.lit("other")))
    battery = t.benchmark.select(
        i.alias("id"), pick(4, "refuse", "contains_all", "contains_any", "version_equals").alias("grade_type"),
        F.array(F.lit("Alpha"), F.lit("BETA 2")).alias("needles"), F.lit("1.4").alias("expected"), gold.alias("gold_chat_ids"))
    answers = t.benchmark.select(
        i.alias("id"), pick(3, "so alpha, then beta 2 is it ", "ALPHA since 1.4, not 1.5", " I can't find this in your archive. ").alias("answer"),
        F.when(i % 5 == 1, F.lit("read Timed Out")).when(i % 5 == 2, F.lit("connection lost")).alias("error"),
        F.when(i % 5 == 0, F.lit("entity")).otherwise(F.lit("rag")).alias("route"), (i * 37 % 100 * 100).cast("bigint").alias("elapsed_ms"))
    retrieved = t.benchmark.select(i.alias("id"), F.when(i % 7 < 4, F.concat(F.lit("g"), i.cast("string"))).otherwise(F.lit("none")).alias("chat_id"))
    return evaluation.answer_rows(battery, answers, retrieved, 6.0)
