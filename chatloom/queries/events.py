"""Queries over ``events``: traces, telemetry, ledgers, windows.

A user is a run; ``value`` is seconds or watts; purchase is a success, error a failure.
"""

from pyspark.sql import Window, functions as F

from chatloom import banks
from chatloom.functions import formats
from chatloom.functions.dates import epoch_to_date, parse_when, recency_weight
from chatloom.operators import cards, catalog, clusters, evaluation, ingest, items, perf, redaction, telemetry
from chatloom.plans.blocks import BLOCK, even, previous, running, running_total
from chatloom.queries.base import Tables, query
from chatloom.session import cut

_EPOCH = "epoch_us(ts) / 1e6"


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)


def _cents():
    """Hundredths of ``value`` as whole numbers: sums are exact in any order."""
    return F.round(F.col("value") * 100).cast("bigint")


def _trace(t: Tables):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        F.concat(F.lit("ollama:m"), (F.col("user_id")).cast("string")).alias("run_id"), "event_id", "event_type",
        _cents().alias("secs"), k.alias("in_tok"), (k * 2).alias("out_tok"), k.alias("usd"), F.lit(None).cast("double").alias("load_ms"),
    )


_SQL_SPEED = """
x AS (SELECT 'ollama:m' || user_id AS model, event_type, round(value * 100)::BIGINT AS secs, json_extract(props, '$.k')::BIGINT AS k FROM events),
sp AS (SELECT model, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS bad,
        sum(CASE WHEN event_type = 'purchase' THEN secs END)::BIGINT AS secs, sum(CASE WHEN event_type = 'purchase' THEN k END)::BIGINT AS k
      FROM x GROUP BY model HAVING ok > 0 AND sum(CASE WHEN event_type = 'purchase' THEN secs END) > 0)"""


@query(
    f"""WITH {_SQL_SPEED}
    SELECT model, (secs / ok)::DOUBLE AS sec_per_item, (2 * k / secs)::DOUBLE AS gen_tok_s, (3 * k / secs)::DOUBLE AS throughput_tok_s,
      ok AS completed, ok + bad AS attempted, (ok / (ok + bad))::DOUBLE AS completion_rate,
      (k::DOUBLE / ok * 1000) AS usd_per_1k_items FROM sp"""
)
def perf_leaderboard(t: Tables):
    """Speed, reliability and cost per model, fastest first."""
    rows = perf.model_speed(_trace(t), ok="purchase", fail="error")
    shown = rows.select(
        "model", "sec_per_item", "gen_tok_s", "throughput_tok_s", "completed", "attempted", "completion_rate", "usd_per_1k_items"
    )
    return shown.orderBy(*perf.speed_order(), "model")


_SQL_ENERGY = f"""
p AS (SELECT user_id, {_EPOCH} AS t, value AS w, lag({_EPOCH}) OVER o AS t0, lag(value) OVER o AS w0 FROM events
      WINDOW o AS (PARTITION BY user_id ORDER BY {_EPOCH}, value)),
en AS (SELECT user_id, count(*) AS n_points, max(t) - min(t) AS duration_s,
        CASE WHEN count(*) >= 2 THEN sum(CASE WHEN t > t0 THEN (w + w0) / 2 * (t - t0) ELSE 0 END) / 3600 END AS wh FROM p GROUP BY 1)"""


def _energy(t: Tables):
    points = t.events.select("user_id", seconds().alias("t"), F.col("value").alias("w"))
    return telemetry.energy_wh(points, ["user_id"], "t", "w")


@query(f"WITH {_SQL_ENERGY} SELECT user_id, n_points, round(duration_s, 3) AS duration_s, round(wh, 4) AS wh FROM en")
def energy_wh(t: Tables):
    return _energy(t).select("user_id", "n_points", F.round("duration_s", 3).alias("duration_s"), F.round("wh", 4).alias("wh"))


@query(
    f"""WITH {_SQL_ENERGY}, n AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1)
    SELECT user_id, round(wh / ok, 4) AS wh_per_item FROM n JOIN en USING (user_id) WHERE ok > 0"""
)
def wh_per_item(t: Tables):
    """Energy joined to the run it belongs to, per completed item."""
    done = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("ok"))
    return done.join(_energy(t), "user_id").select("user_id", F.round(F.col("wh") / F.col("ok"), 4).alias("wh_per_item"))


@query(
    f"""WITH m AS (SELECT user_id, {_EPOCH} AS t, round(value * 100)::BIGINT AS power_w, json_extract(props, '$.k')::DOUBLE AS temp_c FROM events)
    SELECT user_id, count(*) AS n_samples, round(max(t) - min(t), 3) AS duration_s, round(avg(power_w)::DECIMAL(18, 9), 2)::DOUBLE AS power_w_avg,
      max(power_w) AS power_w_peak, min(power_w) AS power_w_min, round(avg(temp_c)::DECIMAL(18, 9), 2)::DOUBLE AS temp_c_avg,
      round(max(temp_c), 2) AS temp_c_peak, round(min(temp_c), 2) AS temp_c_min, (max(temp_c) >= 83)::BIGINT AS throttled FROM m GROUP BY 1"""
)
def telemetry_summary(t: Tables):
    rows = t.events.select(
        "user_id", seconds().alias("t"), _cents().alias("power_w"), F.get_json_object("props", "$.k").cast("double").alias("temp_c")
    )
    out = telemetry.summary(rows, ["user_id"])
    return out.withColumn("duration_s", F.round("duration_s", 3)).withColumn("throttled", F.col("throttled").cast("bigint"))


@query(
    """WITH i AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS value, min(event_id) OVER (PARTITION BY user_id) AS f FROM events WHERE event_type = 'purchase'),
    a AS (SELECT user_id, count(*) AS items, sum(value)::BIGINT AS total, max(value) FILTER (event_id = f) AS first_secs,
            quantile_cont(value, 0.5) FILTER (event_id > f) AS med FROM i GROUP BY 1)
    SELECT user_id, items, (total / items)::DOUBLE AS s_per_item,
      (CASE WHEN items >= 2 THEN med ELSE total / items END)::DOUBLE AS warm_s_per_item,
      (CASE WHEN items >= 2 THEN greatest(first_secs - med, 0) ELSE 0 END)::DOUBLE AS load_s, 'est' AS load_kind FROM a"""
)
def load_warm_split(t: Tables):
    """Cold-load and warm time per run, in hundredths."""
    rows = t.events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("sequence"), _cents().alias("secs"),
        F.lit(None).cast("double").alias("load_ms"), F.lit(None).cast("double").alias("eval_ms"),
    )
    return perf.load_split(rows, "user_id").drop("gen_only_s_per_item")


@query(
    """SELECT user_id, max(value) AS slowest, arg_min(event_id, (-value, event_id)) AS slowest_id,
      count(*) FILTER (value > 50) AS n_unusable, (count(*) FILTER (value > 50) = 0)::BIGINT AS usable FROM events GROUP BY 1"""
)
def latency_verdict(t: Tables):
    return evaluation.latency_summary(t.events, ["user_id"], "event_id", "value", F.col("value") > 50)


_SQL_STRIKES = """
z AS (SELECT *, (event_type = 'view')::INT AS idle, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
st AS (SELECT *, CASE WHEN idle = 0 THEN 0 ELSE sum(idle) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) END AS strikes FROM z)"""


def _strikes(t: Tables):
    return telemetry.strikes(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")


@query(f"WITH {_SQL_STRIKES} SELECT event_id, strikes::BIGINT AS strikes FROM st")
def idle_strikes(t: Tables):
    return _strikes(t).select("event_id", "strikes")


@query(
    f"""WITH {_SQL_STRIKES},
    c AS (SELECT event_id, user_id, list_filter([
        CASE WHEN value > 99 THEN 'HOST_DOWN' END, CASE WHEN event_type = 'signup' THEN 'NO_NVIDIA_SMI' END,
        CASE WHEN event_type <> 'purchase' AND value < 1 THEN 'CPU_SPILL' END, CASE WHEN event_type = 'purchase' THEN 'MODEL_NOT_LOADED' END,
        CASE WHEN event_type <> 'signup' AND json_extract(props, '$.k')::DOUBLE / 100 > 0.97 THEN 'VRAM_FULL' END,
        CASE WHEN event_type <> 'signup' AND event_type <> 'purchase' AND NOT value < 1 AND event_type = 'view' AND strikes >= 2 THEN 'GPU_IDLE' END,
        CASE WHEN event_type = 'error' THEN 'LOG_ERRORS' END], lambda x: x IS NOT NULL) AS codes FROM st)
    SELECT event_id, array_to_string(codes, ',') AS codes,
      CASE WHEN list_has_any(codes, ['HOST_DOWN', 'CPU_SPILL']) THEN 'FATAL' WHEN len(codes) > 0 THEN 'WARN' ELSE 'OK' END AS status FROM c"""
)
def health_codes(t: Tables):
    """Codes and status of every sample."""
    kind = F.col("event_type")
    codes = telemetry.health_codes(
        {
            "host_up": ~(F.col("value") > 99), "gpu_available": kind != "signup", "model_loaded": kind != "purchase",
            "on_gpu": ~(F.col("value") < 1), "running": F.lit(True),
            "mem_frac": F.get_json_object("props", "$.k").cast("double") / 100,
            "util_pct": F.when(kind == "view", F.lit(0.0)).otherwise(F.lit(50.0)), "idle_strikes": F.col("strikes"),
            "n_log_errors": F.when(kind == "error", 1).otherwise(0),
        }
    )
    rows = _strikes(t).withColumn("c", codes)
    return rows.select("event_id", F.array_join("c", ",").alias("codes"), telemetry.health_status(F.col("c")).alias("status"))


@query(
    """SELECT user_id, CASE max(CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' THEN 1 ELSE 0 END)
      WHEN 2 THEN 'FATAL' WHEN 1 THEN 'WARN' ELSE 'OK' END AS worst FROM events GROUP BY 1"""
)
def worst_status(t: Tables):
    status = F.when(F.col("event_type") == "error", "FATAL").when(F.col("event_type") == "view", "WARN").otherwise("OK")
    return t.events.groupBy("user_id").agg(telemetry.worst_status(status).alias("worst"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def trace_sequence(t: Tables):
    out = perf.numbered(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"])
    return out.select("event_id", "user_id", "sequence")


# --- windows --------------------------------------------------------------


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, avg(round(value * 100)::BIGINT) AS avg_value,
      max(round(value * 100)::BIGINT) AS peak_value FROM events GROUP BY 1, 2"""
)
def tumbling_windows(t: Tables):
    """Hourly averages and peaks, in hundredths."""
    w = F.window("ts", "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_cents()).alias("avg_value"), F.max(_cents()).alias("peak_value")
    ).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "avg_value", "peak_value")


@query(
    """WITH s AS (SELECT ts, value, unnest(range(0, 4)) AS i FROM events)
    SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M') AS start, count(*) AS n, avg(round(value * 100)::BIGINT) AS avg_value
    FROM s GROUP BY 1"""
)
def sliding_windows(t: Tables):
    w = F.window("ts", "1 hour", "15 minutes")
    return t.events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(_cents()).alias("avg_value")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "avg_value"
    )


@query(
    """WITH f AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true)::INT AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM f)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, sid"""
)
def session_windows(t: Tables):
    """Activity sessions with gaps of at most 30 minutes, found over even blocks of (user, time)."""
    order, block = ["ts", "event_id"], F.col(BLOCK)
    e = even(t.events.select("user_id", "ts", "event_id", "value", seconds().alias("s")), ["user_id"], order)
    flagged = previous(e, ["user_id"], order, block, {"s0": F.col("s")}).withColumn(
        "new", F.when(F.col("s") - F.col("s0") <= 1800, 0).otherwise(1).cast("bigint")
    )
    # Written once: numbering reads the flags for its block totals and for the rows.
    flagged = cut(flagged.select("user_id", "ts", "event_id", "value", "new", BLOCK))
    numbered = running(flagged, ["user_id"], order, block, {"sid": ("sum", F.col("new"))})
    return numbered.groupBy("user_id", "sid").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("start"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    ).drop("sid")


@query(
    """SELECT event_id, 'u' || user_id || '@run.org' AS run_id, '‹email› did ' || event_type || ' at ‹path›' AS message, 'from ‹ip›' AS error, value, props FROM events"""
)
def scrub_events(t: Tables):
    """Trace events with scrubbed message and payload; run ids and numbers stay."""
    user = F.col("user_id").cast("string")
    rows = t.events.select(
        "event_id", F.concat(F.lit("u"), user, F.lit("@run.org")).alias("run_id"),
        F.concat(F.lit("u"), user, F.lit("@mail.org did "), F.col("event_type"), F.lit(" at /home/u"), user, F.lit("/log")).alias("message"),
        F.struct(F.concat(F.lit("from 10.1."), F.pmod("user_id", F.lit(250)).cast("string"), F.lit(".7")).alias("error"), "value", "props").alias("payload"))
    return redaction.scrub_trace(rows).select("event_id", "run_id", "message", "payload.error", "payload.value", "payload.props")


# --- ingest and ledgers ---------------------------------------------------


@query(
    """SELECT user_id, event_id, value AS update_time FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1"""
)
def newest_wins(t: Tables):
    """Latest version of each key; the first copy wins equal times."""
    rows = t.events.select("user_id", "event_id", F.col("value").alias("update_time"))
    return ingest.newest_wins(rows, None, "user_id", "update_time", "event_id")


@query(
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_processed, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_processed,
      count(*) AS runs, arg_max(value, (ts, value, event_id)) AS value, arg_max(event_id, (ts, value, event_id)) AS event_id FROM events GROUP BY 1"""
)
def ledger_rollup(t: Tables):
    out = ingest.ledger(t.events, "user_id", "ts", ["value", "event_id"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", day("first_processed"), day("last_processed"), "runs", "value", "event_id")


@query(
    """WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
    SELECT user_id, arg_min(event_type, (-n, f)) AS slug FROM v GROUP BY 1"""
)
def primary_slug(t: Tables):
    """Strongest vote per key, first seen on ties (event types vote for a user)."""
    votes = t.events.groupBy(F.col("user_id").cast("string").alias("conv_id"), F.col("event_type").alias("slug")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("event_id").alias("seen")
    )
    heads = votes.select("conv_id").distinct()
    return cards.primary_slug(heads, votes).select(F.col("conv_id").cast("bigint").alias("user_id"), "slug")


@query(
    """SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'click', 'view') GROUP BY 1"""
)
def coverage_audit(t: Tables):
    """Kinds outside the known set, by anti join to the known list."""
    known = t.spark.createDataFrame([("signup",), ("click",), ("view",)], "event_type string")
    return t.events.join(F.broadcast(known), "event_type", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT count(*) AS served, round(sum(value) / 1000, 5) AS answer_s, arg_max(event_type, (ts, event_id)) AS last_route FROM events"""
)
def query_log_totals(t: Tables):
    log = _log(t)
    return evaluation.query_log(log)[0].withColumn("answer_s", F.round("answer_s", 5))


@query("""SELECT event_id AS id, event_type AS route, value AS elapsed_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def query_log_last(t: Tables):
    return evaluation.query_log(_log(t))[1].select("id", "route", "elapsed_ms")


def _log(t: Tables):
    return t.events.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("route"), F.col("props").alias("question"), F.col("value").alias("elapsed_ms")
    )


@query(
    """SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds FROM events GROUP BY 1"""
)
def stage_timings(t: Tables):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return perf.stage_seconds(spans, ["user_id"], "started", "ended")


# --- scalar columns -------------------------------------------------------


@query(
    """SELECT event_id, round(power(0.5, greatest(0, epoch_us(TIMESTAMP '2024-01-20 00:00:00' - ts::TIMESTAMP) / 86400e6) / 10.0), 6) AS weight,
      strftime(ts, '%Y-%m-%d') AS day FROM events""".replace("epoch_us(TIMESTAMP '2024-01-20 00:00:00' - ts::TIMESTAMP)", "(epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts))")
)
def recency_weights(t: Tables):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    w = recency_weight(parse_when(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), now, 10.0)
    return t.events.select("event_id", F.round(w, 6).alias("weight"), epoch_to_date(seconds()).alias("day"))


@query(
    """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k,
      CASE WHEN isnan(c) THEN 0 ELSE greatest(0, least(1, c)) END AS confidence FROM (SELECT *, json_extract(props, '$.k')::DOUBLE / 50 - 0.5 AS c FROM events)"""
)
def json_recovery(t: Tables):
    """Objects recovered from answers with prose around them, and clamped confidence."""
    noisy = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Hope that helps."))
    v = items.recover_object(noisy)
    k = F.try_variant_get(v, "$.k", "bigint")
    return t.events.select("event_id", k.alias("k"), items.clamp_confidence((k / F.lit(50.0) - 0.5).cast("string")).alias("confidence"))


@query(
    """SELECT event_id, CASE WHEN value >= 10 THEN printf('%.0fs', round_even(value, 0)) WHEN value >= 0.1 THEN printf('%.1fs', round(value, 1))
        WHEN value >= 0.0005 THEN printf('%.0fms', value * 1000) ELSE '<1ms' END AS took,
      CASE WHEN f >= 0.99 THEN '100% GPU' WHEN f <= 0.01 THEN '100% CPU'
        ELSE round_even((1 - f) * 100, 0)::INT || '%/' || round_even(f * 100, 0)::INT || '% CPU/GPU' END AS placement
    FROM (SELECT *, json_extract(props, '$.k')::DOUBLE / 99 AS f FROM events)"""
)
def labels_of_samples(t: Tables):
    """Elapsed-time and placement labels."""
    f = F.get_json_object("props", "$.k").cast("double") / 99
    # Whole seconds are rounded half to even before printing, as the SQL does.
    v = F.when(F.col("value") >= 10, F.bround("value", 0)).otherwise(F.col("value"))
    return t.events.select("event_id", formats.duration(v).alias("took"), formats.placement(f).alias("placement"))


@query(
    """SELECT event_type, count(*) AS n_items, count(*) * CASE event_type WHEN 'view' THEN 45 WHEN 'click' THEN 8 ELSE 30 END AS eta_seconds,
      greatest(20, floor(sum(value) * 1048576 / 1073741824 * 90))::BIGINT AS extract_seconds FROM events GROUP BY 1"""
)
def eta_estimates(t: Tables):
    provider = F.when(F.col("event_type") == "view", "ollama").when(F.col("event_type") == "click", "openai").otherwise("other")
    rows = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("value"), 4).alias("mib"))
    return rows.select(
        "event_type", "n_items", formats.item_estimate_seconds(
            F.when(F.col("event_type") == "view", "ollama").when(F.col("event_type") == "click", "openai").otherwise("other"), F.col("n_items")
        ).alias("eta_seconds"),
        formats.extract_estimate_seconds(F.col("mib") * 1048576).alias("extract_seconds"),
    )


@query(
    """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT event_type, count(*) AS size FROM n GROUP BY 1)
    SELECT user_id, event_type AS slug FROM n JOIN g USING (event_type) WHERE size >= 2 AND (size <= 12 OR event_type = 'error')"""
)
def generic_slug_guard(t: Tables):
    """Memberships that may merge: small groups, or groups an archive backs (here: error)."""
    pairs = t.events.select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("slug")).distinct()
    backed = pairs.where("slug = 'error'").withColumn("is_version", F.lit(True))
    return clusters.edges(pairs, backed).select(F.col("conv_id").alias("user_id"), "slug")


@query(
    """SELECT user_id, array_to_string(list_transform(list_sort(list((f, event_type))), lambda x: x[2]), ',') AS kinds FROM (
      SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1""".replace(
        "list_transform(list_sort(list((f, event_type))), lambda x: x[2])", "list(event_type ORDER BY f)"
    )
)
def ordered_distinct(t: Tables):
    """Distinct kinds per run in order of first appearance."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds")
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS update_date, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id) AS rank FROM events WHERE contains(event_type, 'i')")
def chats_by_date(t: Tables):
    """All chats whose title holds a word part, newest first; the place in that order is counted over even parts."""
    cards = t.events.select(F.col("event_id").alias("conv_id"), F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("update_date"))
    listed = catalog.list_chats(cards, "i").withColumn("_back", -F.unix_date(F.to_date("update_date")))
    placed = running_total(listed, ["_back", "conv_id"], F.lit(1), "before")
    return placed.select(F.col("conv_id").alias("event_id"), "update_date", (F.col("before") + 1).cast("bigint").alias("rank"))
