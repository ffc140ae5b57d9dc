"""Queries over the order tables: ingest, spend, archives, catalog lists, banks, contracts.

A customer is a cluster, an order a conversation, a line a version archive or a batch item.
"""

from pyspark.sql import functions as F

from chatloom import banks
from chatloom.functions import formats, text as T
from chatloom.operators import bundles, catalog, contracts, entities, ingest, items, modelbank, perf, quality, redaction, states
from chatloom.queries.base import Tables, query, values

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _day(c="o_orderdate"):
    return F.date_format(c, "yyyy-MM-dd")


def _clusters(t: Tables):
    """Customers as clusters: finished orders count as versions."""
    return t.orders.groupBy(F.col("o_custkey").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_versions"),
        F.min(_day()).alias("start_date"),
        F.max(_day()).alias("end_date"),
    )


_SQL_CLUSTERS = f"""
cl AS (SELECT o_custkey AS cluster_id, count(*) AS n_conversations, count(*) FILTER (o_orderstatus = 'F') AS n_versions,
        min({_DAY}) AS start_date, max({_DAY}) AS end_date FROM orders GROUP BY 1)"""
_ORDER = "n_versions DESC, end_date DESC, n_conversations DESC, cluster_id"


# --- ingest ---------------------------------------------------------------


def _batch(t: Tables):
    """Orders as incoming copies of customers; the order date is the version."""
    days = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double")
    return t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("source_zip"), days.alias("update_time")
    )


def _store(t: Tables):
    return t.customer.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey"), F.lit(3000.0).alias("update_time")
    )


_SQL_OUTCOMES = """
b AS (SELECT o_orderkey, o_custkey, o_orderpriority AS source_zip, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS ut FROM orders),
u AS (SELECT o_custkey, o_orderkey, source_zip, ut, 1 AS new FROM b UNION ALL SELECT c_custkey, -1, NULL, 3000.0, 0 FROM customer WHERE c_mktsegment = 'BUILDING'),
p AS (SELECT *, max(ut) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM u),
oc AS (SELECT *, CASE WHEN best IS NULL THEN 'added' WHEN ut > best THEN 'updated' ELSE 'skipped' END AS status FROM p WHERE new = 1)"""


def _outcomes(t: Tables):
    return ingest.outcomes(_batch(t), _store(t), "o_custkey", "update_time", "o_orderkey", width=4096)


@query(f"WITH {_SQL_OUTCOMES} SELECT source_zip, count(*) AS seen, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status <> 'skipped') AS written FROM oc GROUP BY 1")
def ingest_tallies(t: Tables):
    return ingest.tallies(_outcomes(t), ["source_zip"])


@query(f"WITH {_SQL_OUTCOMES} SELECT o_orderkey, o_custkey, status FROM oc WHERE status <> 'skipped' ORDER BY o_orderkey LIMIT 100")
def ingest_limit(t: Tables):
    """The first hundred new or changed rows in source order."""
    return ingest.limited(_outcomes(t), "o_orderkey", 100).select("o_orderkey", "o_custkey", "status")


@query(
    f"""WITH {_SQL_OUTCOMES},
    l AS (SELECT source_zip, count(*) AS seen, count(*) FILTER (status <> 'skipped') AS written, count(*) FILTER (status = 'skipped') AS skipped FROM oc GROUP BY 1)
    SELECT source_zip, CASE WHEN seen <= 0 THEN 'empty' WHEN written + skipped >= seen THEN 'full' ELSE 'partial' END AS status FROM l"""
)
def ledger_status(t: Tables):
    rows = ingest.tallies(_outcomes(t), ["source_zip"])
    return rows.select("source_zip", ingest.ledger_status(F.col("seen"), F.col("written"), F.col("skipped")).alias("status"))


@query(
    """WITH l AS (SELECT o_orderpriority AS zip, count(*) AS seen, count(*) FILTER (o_orderstatus = 'P') AS skipped FROM orders GROUP BY 1)
    SELECT sum(seen)::BIGINT AS seen, sum(skipped)::BIGINT AS skipped, round_even(round_even(100.0::DOUBLE * (sum(seen) - sum(skipped)) / sum(seen), 1) * 3 / 4, 1) AS coverage FROM l"""
)
def coverage_score(t: Tables):
    """Captured share over all archives, lowered by one lost shard in four."""
    led = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("o_orderstatus") == "P").alias("skipped"))
    rows = led.select("seen", "skipped", F.lit(0).alias("written"), F.lit(4).alias("shards_total"), F.lit(3).alias("shards_parsed"))
    return states.coverage(rows).select("seen", "skipped", "coverage")


# --- completeness ---------------------------------------------------------


def _coverage(t: Tables):
    exports = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_returnflag")
    return catalog.id_coverage(t.orders.select(F.col("o_orderkey").alias("id")), exports, F.col("l_returnflag") == "R", "id")


_SQL_IDS = """
cat AS (SELECT o_orderkey AS id FROM orders), ex AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
nw AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')"""


@query(
    f"""WITH {_SQL_IDS}
    SELECT (SELECT count(*) FROM cat) AS n_catalog, (SELECT count(*) FROM ex) AS n_union, (SELECT count(*) FROM nw) AS n_newest,
      (SELECT count(*) FROM cat WHERE id NOT IN (FROM nw)) AS older_only, (SELECT count(*) FROM ex WHERE id NOT IN (FROM cat)) AS missing_from_catalog,
      (SELECT count(*) FROM cat WHERE id NOT IN (FROM ex)) AS not_in_any_export, (SELECT count(*) FROM nw WHERE id NOT IN (FROM cat)) AS newest_missing"""
)
def completeness_checks(t: Tables):
    return catalog.completeness(_coverage(t))


@query(
    f"""WITH {_SQL_IDS}
    SELECT 'files_on_disk' AS check_id, 1::BIGINT AS ok UNION ALL SELECT 'parse_complete', 0
    UNION ALL SELECT 'newest_in_catalog', (NOT EXISTS (SELECT id FROM nw EXCEPT SELECT id FROM cat))::BIGINT
    UNION ALL SELECT 'catalog_in_exports', (NOT EXISTS (SELECT id FROM cat EXCEPT SELECT id FROM ex))::BIGINT
    UNION ALL SELECT 'export_union', (NOT EXISTS (SELECT id FROM ex EXCEPT SELECT id FROM cat))::BIGINT"""
)
def verify_verdict(t: Tables):
    rows = catalog.verdict(catalog.completeness(_coverage(t)), F.lit(True), F.lit(False))
    return rows.withColumn("ok", F.col("ok").cast("bigint"))


@query(
    f"""WITH {_SQL_IDS} SELECT o_orderkey AS id, {_DAY} AS update_date FROM orders WHERE o_orderkey NOT IN (FROM nw)
    ORDER BY 2 DESC, 1 LIMIT 20"""
)
def older_only(t: Tables):
    """Newest twenty chats that the newest export no longer holds."""
    gone = _coverage(t).where("in_catalog = 1 AND in_newest = 0").select("id")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), _day().alias("update_date")).join(gone, "id", "left_semi")
    return rows.orderBy(F.desc("update_date"), "id").limit(20)


@query(
    """WITH led AS (SELECT o_custkey AS b, count(*) AS seen, count(*) FILTER (o_orderstatus <> 'P') AS written, 0 AS skipped, max(o_orderdate) AS lp FROM orders
                    WHERE o_orderstatus IN ('F', 'P') GROUP BY 1),
    disk AS (SELECT c_custkey AS b, 'zips/' || c_name AS path, round(c_acctbal)::BIGINT AS file_size FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    own AS (SELECT c_custkey + c_nationkey AS b, count(*) AS chats FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT coalesce(led.b, disk.b, own.b) AS basename, path, file_size AS size_bytes,
      CASE WHEN led.b IS NOT NULL THEN CASE WHEN seen <= 0 THEN 'empty' WHEN written + skipped >= seen THEN 'full' ELSE 'partial' END
           WHEN path IS NOT NULL THEN 'not_processed' WHEN coalesce(chats, 0) > 0 THEN 'indexed' ELSE 'missing' END AS status,
      coalesce(chats, 0) AS chats_in_store, seen FROM led FULL JOIN disk ON led.b = disk.b FULL JOIN own ON own.b = coalesce(led.b, disk.b)"""
)
def archive_status(t: Tables):
    """Ledger, disk and owned chats matched on the archive name (three-way full outer join)."""
    key = lambda c: c.cast("string").alias("basename")
    led = t.orders.where(F.col("o_orderstatus").isin("F", "P")).groupBy(key(F.col("o_custkey"))).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("o_orderstatus") != "P").alias("written"), F.max(_day()).alias("last_processed")
    ).withColumn("skipped", F.lit(0)).withColumn("size", F.lit(None).cast("bigint"))
    disk = t.customer.where("c_mktsegment <> 'MACHINERY'").select(
        key(F.col("c_custkey")), F.concat(F.lit("zips/"), "c_name").alias("path"), F.round("c_acctbal").cast("bigint").alias("file_size")
    )
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        key(F.col("c_custkey") + F.col("c_nationkey"))
    ).agg(F.count(F.lit(1)).alias("chats"))
    out = catalog.archive_status(led, disk, own).orderBy(*catalog.archive_order())
    return out.select(F.col("basename").cast("bigint").alias("basename"), "path", "size_bytes", "status", "chats_in_store", "seen")


# --- lists ----------------------------------------------------------------


@query(f"WITH {_SQL_CLUSTERS} SELECT cluster_id, n_conversations, n_versions, start_date, end_date FROM cl WHERE n_versions >= 1 OR n_conversations >= 2 ORDER BY {_ORDER} LIMIT 40")
def project_list(t: Tables):
    rows = _clusters(t).withColumn("slug", F.lpad(F.col("cluster_id").cast("string"), 12, "0"))
    return catalog.list_projects(rows, limit=40).select("cluster_id", "n_conversations", "n_versions", "start_date", "end_date")


@query(f"WITH {_SQL_CLUSTERS} SELECT cluster_id, n_versions FROM cl WHERE n_versions >= 4")
def bundle_selection(t: Tables):
    """Clusters with at least four versions, whatever their number of chats."""
    return bundles.select_clusters(_clusters(t), min_versions=4, multi_chat=False).select("cluster_id", "n_versions")


_SQL_ITEMS = """
it AS (SELECT c_custkey AS cluster_id, c_name AS title, CASE c_mktsegment WHEN 'BUILDING' THEN 'software_app' WHEN 'MACHINERY' THEN 'knowledge_qa'
         WHEN 'HOUSEHOLD' THEN 'content_writing' ELSE 'personal_admin' END AS archetype, c_acctbal > 5000 AS durable FROM customer WHERE c_acctbal > 0)"""


def _enriched(t: Tables):
    seg = F.col("c_mktsegment")
    arch = F.when(seg == "BUILDING", "software_app").when(seg == "MACHINERY", "knowledge_qa").when(seg == "HOUSEHOLD", "content_writing").otherwise("personal_admin")
    known = t.customer.where("c_acctbal > 0").select(
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("slug"), F.col("c_name").alias("title"), arch.alias("archetype"),
        (F.col("c_acctbal") > 5000).alias("is_durable_project"), F.lit("").alias("goal"), F.lit(None).cast("bigint").alias("n_passes"),
    )
    rows = _clusters(t).withColumn("slug", F.lpad(F.col("cluster_id").cast("string"), 12, "0"))
    return catalog.enriched_projects(rows, known)


@query(
    f"""WITH {_SQL_CLUSTERS}, {_SQL_ITEMS}
    SELECT cluster_id, coalesce(title, lpad(cluster_id::VARCHAR, 12, '0')) AS title, archetype, (it.cluster_id IS NOT NULL)::BIGINT AS classified,
      concat_ws(',', CASE WHEN archetype = 'software_app' THEN 'app' END, CASE WHEN durable THEN 'project' END,
        CASE WHEN archetype IN ('knowledge_qa', 'content_writing') AND NOT durable THEN 'idea' END) AS categories
    FROM cl LEFT JOIN it USING (cluster_id)""".replace("(it.cluster_id IS NOT NULL)", "(archetype IS NOT NULL)")
)
def enriched_projects(t: Tables):
    out = _enriched(t)
    return out.select(
        "cluster_id", "title", "archetype", F.col("classified").cast("bigint").alias("classified"), F.array_join("categories", ",").alias("categories")
    )


@query(
    f"""WITH {_SQL_CLUSTERS}, {_SQL_ITEMS},
    x AS (SELECT cl.*, archetype, unnest(list_filter([CASE WHEN archetype = 'software_app' THEN 'app' END, CASE WHEN durable THEN 'project' END,
        CASE WHEN archetype IN ('knowledge_qa', 'content_writing') AND NOT durable THEN 'idea' END], lambda c: c IS NOT NULL)) AS category FROM cl JOIN it USING (cluster_id))
    SELECT category, cluster_id, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS rank FROM x QUALIFY rank <= 15"""
)
def category_tree(t: Tables):
    rows = catalog.category_tree(_enriched(t), per_category=15)
    return rows.select("category", "cluster_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_SQL_ITEMS} SELECT o_orderkey AS conv_id FROM orders WHERE o_custkey NOT IN (SELECT cluster_id FROM it)")
def uncategorized_chats(t: Tables):
    members = t.orders.select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("conv_id"))
    return catalog.uncategorized_chats(members.select("conv_id"), members, _enriched(t)).select("conv_id")


@query(
    """SELECT o_orderkey AS cluster_id, l.l_linenumber::BIGINT AS conv_id, coalesce(c.c_name, '(untitled)') AS title, coalesce(c.c_nationkey, 0)::BIGINT AS n_turns
    FROM orders JOIN lineitem l ON l_orderkey = o_orderkey LEFT JOIN customer c ON c_custkey = l_partkey"""
)
def member_chats(t: Tables):
    """Members of each cluster with the facts of their card, if there is one."""
    members = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("cluster_id"), F.col("l_linenumber").cast("bigint").alias("no"), F.col("l_partkey").alias("conv_id")
    )
    facts = t.customer.select(
        F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("update_date"),
        F.lit(None).cast("string").alias("create_date"), F.col("c_nationkey").cast("bigint").alias("n_turns"), F.col("c_mktsegment").alias("source_zip"),
    )
    numbered = members.select("cluster_id", F.struct("conv_id", "no").alias("m"))
    flat = numbered.select("cluster_id", "m.conv_id", "m.no")
    rows = catalog.chat_rows(flat.select(F.struct("cluster_id", "no").alias("cluster_id"), "conv_id"), facts)
    return rows.select("cluster_id.cluster_id", F.col("cluster_id.no").alias("conv_id"), "title", "n_turns")


@query(
    """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) FILTER (r <= 8) || CASE WHEN any_value(n) > 8 THEN ',...(+' || (any_value(n) - 8) || ' more)' ELSE '' END AS titles,
      any_value(n) AS n_total FROM n GROUP BY 1"""
)
def first_titles(t: Tables):
    rows = bundles.first_n(t.orders.withColumn("title", F.col("o_orderkey").cast("string")), ["o_custkey"], ["o_orderkey"], "title", 8)
    return rows.select("o_custkey", F.array_join("title", ",").alias("titles"), "n_total")


@query(
    """SELECT id, kind FROM (
      (SELECT s_suppkey AS id, 'project' AS kind, 0 AS src, s_nationkey AS v, '' AS d FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 120)
      UNION ALL (SELECT c_custkey, 'chat', 1, 0, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 120))
    ORDER BY src, v DESC, d DESC, id LIMIT 120"""
)
def mixed_search(t: Tables):
    p = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.lit("").alias("end_date"), F.col("s_nationkey").alias("n_versions"), F.lit(0).alias("n_conversations")
    )
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("end_date"), F.lit(0).alias("n_versions"), F.lit(0).alias("n_conversations"))
    return catalog.mixed_search(p, c, 120).select("id", "kind")


@query(
    f"""WITH {_SQL_CLUSTERS} SELECT count(*) FILTER (n_versions >= 1 OR n_conversations >= 2) AS n_projects,
      count(*) FILTER (n_versions > 0) AS n_projects_with_zips, least(min(start_date), min(end_date)) AS date_min, greatest(max(start_date), max(end_date)) AS date_max FROM cl"""
)
def catalog_state(t: Tables):
    return catalog.state(_clusters(t))


@query(
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR regexp_matches(lower(p_type), '^econ.*y$')"""
)
def name_filter(t: Tables):
    """List filters: a literal anywhere in the name, or a glob over the whole type."""
    keep = T.name_matches(F.col("p_name"), "RING") | T.name_matches(F.col("p_type"), "ECON*Y")
    return t.part.where(keep).select("p_partkey", "p_name")


@query(
    """SELECT p_partkey, CASE WHEN contains(p_name, 'ed') AND contains(p_type, 'ED') THEN p_name ELSE CASE WHEN contains(p_name, 'ed') THEN p_name ELSE p_brand END END AS files
    FROM part WHERE contains(p_name, 'ed') OR contains(p_brand, 'ed')"""
)
def file_search(t: Tables):
    rows = t.part.withColumn("att", F.array("p_name")).withColumn("art", F.array("p_brand", "p_name"))
    return catalog.search_files(rows, "ed", "att", "art").select("p_partkey", F.array_join("matched_files", ",").alias("files"))


@query(
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') AS title,
      regexp_replace(regexp_replace(p_brand || '/' || p_type, '[^A-Za-z0-9._:-]+', '-', 'g'), '^-+|-+$', '', 'g') AS token,
      CASE WHEN regexp_matches(p_type, '^ECON') THEN 'economy-sweep' WHEN regexp_matches(p_type, 'ROMO') THEN 'promo-sweep'
        ELSE regexp_replace(p_type, '[^A-Za-z0-9._:-]+', '-', 'g') END AS workload FROM part"""
)
def label_columns(t: Tables):
    """Readable titles, safe ids and workloads."""
    rules = [("^ECON", "economy-sweep"), ("ROMO", "promo-sweep")]
    return t.part.select(
        "p_partkey", T.human_title(F.translate("p_name", " ", "-")).alias("title"),
        formats.token_id(F.concat_ws("/", "p_brand", "p_type")).alias("token"), formats.workload(F.col("p_type"), rules).alias("workload"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_size < 20 THEN 'local $0' WHEN p_size < 30 THEN 'token (pay-per-use)' ELSE p_brand || ' $' || p_size || '/mo' || CASE WHEN p_size > 40 THEN ' · metered' ELSE '' END END AS billing,
      'compl ' || p_size || '/50' || CASE WHEN p_size > 25 THEN ' · depth* ' || (p_size + 50) || '%' ELSE '' END AS bench FROM part"""
)
def bank_labels(t: Tables):
    size = F.col("p_size")
    kind = F.when(size < 20, "local").when(size < 30, "token").otherwise("subscription")
    return t.part.select(
        "p_partkey",
        formats.billing_label(kind, F.col("p_brand"), F.lit("plan"), size.cast("double"), F.lit("month"), size > 40).alias("billing"),
        formats.benchmark_summary({"completed": size, "n_items": F.lit(50), "depth_on_success_pct": F.when(size > 25, size + 50)}).alias("bench"),
    )


@query("SELECT c_custkey, regexp_replace(c_name, '^.*#', '') AS filename FROM customer")
def public_items(t: Tables):
    """Public records: internal columns gone, paths cut to base names."""
    rows = t.customer.select(
        "c_custkey", F.array(F.struct(F.translate("c_name", "#", "/").alias("filename"))).alias("version_zip_files"),
        F.col("c_acctbal").alias("cost_usd"), F.lit("x").alias("bundle_sha"),
    )
    out = redaction.public_items(rows, scrub=True)
    return out.select("c_custkey", F.col("version_zip_files")[0]["filename"].alias("filename")).select(*out.columns[:1], "filename")


# --- spend ----------------------------------------------------------------


def _spend(t: Tables):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", cents.alias("usd"))


_SQL_BREAKER = """
o AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' AS ok, round(o_totalprice * 100)::BIGINT AS usd FROM orders),
g AS (SELECT *, sum(usd) OVER w AS spent, sum(ok::INT) OVER w AS grp FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
st AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY o_custkey, grp ORDER BY o_orderkey) END AS streak FROM g),
br AS (SELECT *, coalesce(max((streak >= 3 OR spent >= 200000000)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM st)"""


def _breaker(t: Tables):
    return perf.breaker(
        _spend(t), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") != "F", "usd",
        max_failures=3, max_usd=200_000_000,
    )


@query(f"WITH {_SQL_BREAKER} SELECT o_orderkey, streak::BIGINT AS streak, spent::BIGINT AS spent, skipped::BIGINT AS skipped FROM br")
def spend_breaker(t: Tables):
    return _breaker(t).select("o_orderkey", "streak", "spent", F.col("skipped").cast("bigint").alias("skipped"))


@query(
    f"""WITH {_SQL_BREAKER} SELECT o_custkey, count(*) FILTER (NOT skipped) AS n_items, count(*) FILTER (NOT skipped AND NOT ok) AS n_failed,
      count(*) FILTER (skipped) AS n_skipped, coalesce(sum(usd) FILTER (NOT skipped), 0)::BIGINT AS cost, bool_or(skipped)::BIGINT AS breaker_tripped FROM br GROUP BY 1"""
)
def run_totals(t: Tables):
    rows = _breaker(t).withColumn("ok", F.col("o_orderstatus") != "F").withColumn("in_tok", F.lit(1)).withColumn("out_tok", F.lit(1))
    out = perf.run_totals(rows.withColumn("usd", F.col("usd").cast("double")), ["o_custkey"])
    return out.select("o_custkey", "n_items", "n_failed", "n_skipped", F.col("cost_usd").cast("bigint").alias("cost"), F.col("breaker_tripped").cast("bigint").alias("breaker_tripped"))


_RATES = values(list(banks.RATES))


@query(
    f"""WITH r AS (SELECT * FROM {_RATES} v(provider, model, i, o)),
    u AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'openai' WHEN '2-HIGH' THEN 'anthropic' ELSE 'none' END AS provider,
            CASE o_orderstatus WHEN 'F' THEN 'gpt-5' ELSE 'other' END AS model, round(o_totalprice)::BIGINT AS tok FROM orders)
    SELECT o_orderkey, round(tok / 1e6 * coalesce(e.i, s.i, 0)::DOUBLE + tok * 2 / 1e6 * coalesce(e.o, s.o, 0)::DOUBLE, 9) AS usd
    FROM u LEFT JOIN r e ON e.provider = u.provider AND e.model = u.model AND e.model <> '*' LEFT JOIN r s ON s.provider = u.provider AND s.model = '*'"""
)
def rate_wildcard(t: Tables):
    """Usage priced by the exact model, else the provider's wildcard, else nothing."""
    pr, tok = F.col("o_orderpriority"), F.round("o_totalprice").cast("bigint")
    rows = t.orders.select(
        "o_orderkey", F.when(pr == "1-URGENT", "openai").when(pr == "2-HIGH", "anthropic").otherwise("none").alias("provider"),
        F.when(F.col("o_orderstatus") == "F", "gpt-5").otherwise("other").alias("model"), tok.alias("tok"),
    )
    priced = perf.with_rates(rows, perf.rates(t.spark))
    cost = perf.usd(F.col("tok"), F.col("tok") * 2, F.col("usd_in"), F.col("usd_out"))
    return priced.select("o_orderkey", F.round(cost, 9).alias("usd"))


@query(
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(1000.0::DOUBLE * (l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)), 6) AS share FROM lineitem"""
)
def batch_cost_share(t: Tables):
    """A batch total split over its items by size."""
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", F.lit(1000.0).alias("total"))
    out = perf.cost_share(rows, ["l_orderkey"], "l_quantity", "total")
    return out.select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"))


@query(
    """WITH RECURSIVE w AS (
      SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT + 200 AS need,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem),
    f AS (
      SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, r, 0::BIGINT AS batch, 1 AS n, need AS used FROM w WHERE r = 1
      UNION ALL
      SELECT w.l_suppkey, w.l_orderkey, w.l_linenumber, w.l_partkey, w.r, f.batch + (f.n >= 8 OR f.used + w.need > 1700)::INT,
        CASE WHEN f.n >= 8 OR f.used + w.need > 1700 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 8 OR f.used + w.need > 1700 THEN w.need ELSE f.used + w.need END
      FROM f JOIN w ON w.l_suppkey = f.l_suppkey AND w.r = f.r + 1)
    SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, batch FROM f"""
)
def batch_packing(t: Tables):
    """Exact next-fit batches of at most 8 items and 1,700 characters along each supplier's lines."""
    work = t.lineitem.select(
        "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("chars"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    out = items.pack_batches(work, ["l_suppkey"], order, "chars", 8, 1700)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "batch")


# --- banks and dimensions -------------------------------------------------


@query(
    """SELECT n_nationkey::BIGINT AS k, n_name, r_name AS plan, s.n AS suppliers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'
    LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey"""
)
def bank_sidecars(t: Tables):
    """Entries with their plan and benchmark, where known."""
    entries = t.nation.select(
        F.lit("n").alias("provider"), F.col("n_nationkey").cast("string").alias("name"), "n_nationkey", "n_name", F.col("n_regionkey").alias("plan_id")
    )
    plans = t.region.where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("plan_id"), F.col("r_name").alias("plan"))
    bench = t.supplier.groupBy(F.concat(F.lit("n:"), F.col("s_nationkey")).alias("model_key")).agg(F.count(F.lit(1)).alias("suppliers"))
    return modelbank.with_sidecars(entries, plans, bench).select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name", "plan", "suppliers")


_SQL_BANK = """
a AS (SELECT 'codex' AS provider, s_nationkey::VARCHAR AS name, max(s_acctbal) AS v, 1 AS r FROM supplier GROUP BY 2
  UNION ALL SELECT 'codex', c_nationkey::VARCHAR, max(c_acctbal), 0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 12 GROUP BY 2
  UNION ALL SELECT 'ollama', n_nationkey::VARCHAR, n_regionkey::DOUBLE, 2 FROM nation),
bank AS (SELECT provider, name, arg_min(v, r) AS v FROM a GROUP BY 1, 2)"""


def _bank(t: Tables):
    name = lambda c: F.col(c).cast("string").alias("name")
    codex = F.lit("codex").alias("provider")
    static = t.supplier.groupBy(codex, name("s_nationkey")).agg(F.max("s_acctbal").alias("v"))
    local = t.customer.where("c_mktsegment = 'BUILDING' AND c_nationkey < 12").groupBy(codex, name("c_nationkey")).agg(F.max("c_acctbal").alias("v"))
    found = t.nation.select(F.lit("ollama").alias("provider"), name("n_nationkey"), F.col("n_regionkey").cast("double").alias("v"))
    return modelbank.merge(static, local, found)


@query(f"WITH {_SQL_BANK} SELECT provider, name, v FROM bank")
def bank_precedence(t: Tables):
    """Local entries override static ones; discovered entries only add."""
    return _bank(t).select("provider", "name", "v")


@query(
    f"""WITH {_SQL_BANK} SELECT name, provider, n_providers FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n_providers FROM bank)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE provider WHEN 'codex' THEN 0 ELSE 3 END) = 1"""
)
def bank_resolve(t: Tables):
    wanted = t.nation.select(F.col("n_nationkey").cast("string").alias("name"))
    return modelbank.resolve(wanted, _bank(t)).select("name", "provider", "n_providers")


@query(
    """WITH n AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, (n.k IS NOT NULL AND n.v IS DISTINCT FROM o.v)::BIGINT AS changed FROM n FULL JOIN o ON n.k = o.k"""
)
def upsert_changed(t: Tables):
    """Fresh rows over kept rows, with the changed keys marked."""
    old = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return quality.upsert_report(old, new, "k").withColumn("changed", F.col("changed").cast("bigint"))


_SQL_PERF_QUALITY = """
q AS (SELECT c_nationkey AS k, count(*) AS n_items, count(*) FILTER (c_acctbal > 0) AS completed FROM customer WHERE c_nationkey < 20 GROUP BY 1),
p AS (SELECT s_nationkey AS k, count(*) AS attempted, count(*) FILTER (s_acctbal > 0) AS completed, sum(round(s_acctbal * 100)::BIGINT)::BIGINT AS s FROM supplier WHERE s_nationkey > 3 GROUP BY 1)"""


@query(
    f"""WITH {_SQL_PERF_QUALITY}
    SELECT 'm' || coalesce(q.k, p.k) || ':m' || coalesce(q.k, p.k) AS model_key, coalesce(n_items, attempted) AS n_items, coalesce(q.completed, p.completed) AS completed,
      CASE WHEN q.k IS NOT NULL THEN round_even(q.completed / n_items * 100, 0) ELSE round_even(p.completed / attempted * 100, 0) END AS completion_pct, s::DOUBLE AS sec_per_item
    FROM q FULL JOIN p ON q.k = p.k"""
)
def perf_quality_full_outer(t: Tables):
    """Quality and speed of models side by side; one side may be missing."""
    model = lambda c: F.concat(F.lit("m"), F.col(c)).alias("model")
    q = t.customer.where("c_nationkey < 20").groupBy(model("c_nationkey")).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("c_acctbal") > 0).alias("completed")
    ).withColumn("completion_pct", quality.pct(F.col("completed") / F.col("n_items")))
    p = t.supplier.where("s_nationkey > 3").groupBy(model("s_nationkey")).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("s_acctbal") > 0).alias("completed"),
        F.sum(F.round(F.col("s_acctbal") * 100).cast("bigint")).cast("double").alias("sec_per_item"),
    ).withColumn("completion_rate", F.col("completed") / F.col("attempted"))
    return quality.benchmark_rows(q, p).select("model_key", "n_items", "completed", "completion_pct", "sec_per_item")


# --- states and rubric ----------------------------------------------------

_COORDS = {"COORD-B-COMPLETION": "p_size", "COORD-B-DEPTH": "depth"}


def _states(t: Tables):
    rows = t.part.select(
        F.col("p_type").alias("workload"), F.col("p_partkey").alias("model"), "p_size",
        F.when(F.col("p_size") > 10, F.col("p_size") * 2).alias("depth"), "p_retailprice",
    )
    return states.coordinates(rows, ["workload", "model"], _COORDS, {"COORD-B-SPEED": ("p_retailprice", "seconds")})


_SQL_STATES = """
lg AS (SELECT p_type AS workload, p_partkey AS model, 'COORD-B-COMPLETION' AS coordinate, p_size::DOUBLE AS attainment, p_size::DOUBLE AS value, 'p_size' AS metric FROM part
  UNION ALL SELECT p_type, p_partkey, 'COORD-B-DEPTH', CASE WHEN p_size > 10 THEN p_size * 2 END, CASE WHEN p_size > 10 THEN p_size * 2 END, CASE WHEN p_size > 10 THEN 'depth' END FROM part
  UNION ALL SELECT p_type, p_partkey, 'COORD-B-SPEED', NULL, p_retailprice, 'p_retailprice' FROM part)"""


@query(
    f"""WITH {_SQL_STATES} SELECT workload, model, coordinate, attainment, value, metric, CASE WHEN value IS NULL THEN 'unknown' ELSE 'measured' END AS status,
      CASE WHEN value IS NULL THEN 0.0 ELSE 0.7 END::DOUBLE AS confidence FROM lg"""
)
def state_unpivot(t: Tables):
    return _states(t).drop("unit")


@query(
    f"""WITH {_SQL_STATES} SELECT workload, model, max(attainment) FILTER (coordinate = 'COORD-B-COMPLETION') AS completion,
      max(attainment) FILTER (coordinate = 'COORD-B-DEPTH') AS depth FROM lg GROUP BY 1, 2"""
)
def cross_sweep_pivot(t: Tables):
    wide = states.sweep_report(_states(t), ["COORD-B-COMPLETION", "COORD-B-DEPTH"])
    return wide.withColumnsRenamed({"COORD-B-COMPLETION": "completion", "COORD-B-DEPTH": "depth"})


_AXES = {"COORD-B-ACCURACY": 30, "COORD-B-COMPLETION": 20, "COORD-D-VERDICT": 20, "COORD-B-DEPTH": 15, "COORD-B-SPEED": 15}


@query(
    """WITH v AS (SELECT n_regionkey AS r, n_nationkey AS n FROM nation),
    att AS (SELECT r, round_even(sum(CASE n // 5 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 15 END / 100.0 * (n * 4)), 3) AS base, count(*) FILTER (n // 5 <= 2) AS known,
              sum(CASE n // 5 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 15 ELSE 0 END)::DOUBLE AS used FROM v GROUP BY r)
    SELECT r_name, base::DOUBLE AS base_score, CASE WHEN r_regionkey = 2 THEN 0.0 WHEN r_regionkey = 3 THEN least(base, 25.0) ELSE base END::DOUBLE AS score,
      CASE WHEN r_regionkey = 2 THEN 'failed' ELSE 'scored' END AS status, used AS used_weight, 5 - known AS n_excluded,
      CASE WHEN r_regionkey IN (2, 3) THEN 1 ELSE 0 END::BIGINT AS n_failed_gates FROM region JOIN att ON r = r_regionkey"""
)
def rubric_score(t: Tables):
    """Gated score per region: axes without a value are left out, one gate fails, one caps."""
    no = F.floor(F.col("n_nationkey") / 5)
    coord = F.when(no == 0, "COORD-B-ACCURACY").when(no == 1, "COORD-B-COMPLETION").when(no == 2, "COORD-B-DEPTH").otherwise("COORD-X")
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    att = named.select("r_name", coord.alias("coordinate"), (F.col("n_nationkey") * 4.0).alias("attainment"))
    gates = t.region.select(
        "r_name", F.lit("G").alias("gate"), F.when(F.col("r_regionkey") == 2, "fail").otherwise("cap_25").alias("effect"),
        (~F.col("r_regionkey").isin(2, 3)).alias("passed"),
    )
    return states.rubric_score(att, _AXES, gates, ["r_name"])


@query(
    """SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'pass' WHEN s_acctbal < 0 THEN 'fail' ELSE 'pass' END AS privacy,
      CASE WHEN s_nationkey = 7 THEN 'unknown' WHEN s_acctbal < 0 OR s_nationkey > 20 THEN 'fail' ELSE 'pass' END AS coverage,
      CASE WHEN s_nationkey = 7 THEN 'unknown' WHEN s_nationkey >= 10 THEN 'pass' ELSE 'cap_50' END AS schema FROM supplier"""
)
def gate_observations(t: Tables):
    nk, low = F.col("s_nationkey"), F.col("s_acctbal") < 0
    model = F.when(nk < 5, "ollama:m").otherwise("openai:m")
    return t.supplier.select(
        "s_suppkey", states.privacy_gate(model, ~low, F.lit(3)).alias("privacy"),
        states.coverage_gate(F.when(nk != 7, F.lit(90.0)), F.when(low, 1).otherwise(0), F.lit(30), F.when(nk > 20, 29).otherwise(30)).alias("coverage"),
        states.schema_gate(F.when(nk != 7, nk * 10.0)).alias("schema"),
    )


# --- contracts ------------------------------------------------------------


@query(
    """SELECT 'custkey required' AS rule, count(*) FILTER (o_custkey IS NULL) AS n_violations, count(*) AS n_rows FROM orders
    UNION ALL SELECT 'status enum', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), count(*) FROM orders
    UNION ALL SELECT 'price range', count(*) FILTER (NOT (o_totalprice BETWEEN 1000 AND 400000)), count(*) FROM orders"""
)
def contract_violations(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    rules = contracts.required("custkey") | contracts.one_of("status", ["F", "O"]) | contracts.within("price", 1000, 400000)
    return contracts.violations(rows, rules)


@query(
    """SELECT 'l_discount range' AS rule, count(*) FILTER (NOT (l_discount * 1000 BETWEEN 0 AND 100)) AS n_violations, count(*) AS n_rows FROM lineitem
    UNION ALL SELECT 'l_quantity range', count(*) FILTER (l_quantity < 0), count(*) FROM lineitem"""
)
def benchmark_contract(t: Tables):
    rows = t.lineitem.select((F.col("l_discount") * 1000).alias("l_discount"), "l_quantity")
    return contracts.violations(rows, contracts.benchmark_rules(["l_discount"], ["l_quantity"]))


@query("SELECT c_custkey, rule FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance range' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment enum' END], lambda r: r IS NOT NULL)) AS rule FROM customer)")
def violating_rows(t: Tables):
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    segments = ["BUILDING", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE"]
    return contracts.violating_rows(rows, "c_custkey", contracts.within("balance", 0) | contracts.one_of("segment", segments))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def dangling_references(t: Tables):
    rows = contracts.dangling(t.nation, "n_regionkey", t.region.where("r_name <> 'ASIA'"), "r_regionkey")
    return rows.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal <= 5000 AND c_mktsegment <> 'HOUSEHOLD'")
def egress_refused(t: Tables):
    """Jobs the egress gate refuses: remote, not scrubbed, no leave to send raw text."""
    provider = F.when(F.col("c_mktsegment") == "BUILDING", "ollama").otherwise("openai")
    blocked = redaction.egress_blocked(provider, F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "HOUSEHOLD")
    return t.customer.where(blocked).select("c_custkey")


@query(f"WITH {_SQL_IDS} (SELECT id, 'both' AS side FROM cat INTERSECT SELECT id, 'both' FROM nw) UNION ALL (SELECT id, 'catalog' FROM cat EXCEPT SELECT id, 'catalog' FROM nw)")
def id_sets(t: Tables):
    """Intersection and difference of two id sets."""
    a = t.orders.select(F.col("o_orderkey").alias("id"))
    b = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("catalog")))


@query(
    """SELECT l_orderkey AS cluster_id, count(*) AS n_members, sum(l_quantity::BIGINT)::BIGINT AS n_turns, min(strftime(l_shipdate, '%Y-%m-%d')) AS start_date,
      max(strftime(l_shipdate, '%Y-%m-%d')) AS end_date, bool_or(l_returnflag = 'R')::BIGINT AS has_r FROM lineitem GROUP BY 1"""
)
def line_rollup(t: Tables):
    """Cluster facts over lines: sums, date range and flags in one aggregate."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n_members"), F.sum(F.col("l_quantity").cast("bigint")).alias("n_turns"),
        F.min(_day("l_shipdate")).alias("start_date"), F.max(_day("l_shipdate")).alias("end_date"),
        F.bool_or(F.col("l_returnflag") == "R").cast("bigint").alias("has_r"),
    )


@query("SELECT l_orderkey AS cluster_id, l_returnflag AS content_type, sum(l_quantity::BIGINT)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def merged_histogram(t: Tables):
    """Per-conversation histograms summed over clusters, as a long table."""
    from chatloom.operators.clusters import merged_counts

    member = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("conv_id"), F.col("l_orderkey").alias("cluster_id")).distinct()
    counts = t.lineitem.groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("conv_id"), F.col("l_returnflag").alias("content_type")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("n")
    )
    return merged_counts(member, counts, "content_type")


# --- contracts and product facts ------------------------------------------

_ARCHETYPES = sorted({a for a, _, _ in banks.FIELD_CONTRACT})
_ARCH_SQL = "[" + ", ".join(f"'{a}'" for a in _ARCHETYPES) + "]"
_DEMANDED = values([(a, f) for a, f, _ in banks.FIELD_CONTRACT if (a, f) not in banks.OPTIONAL_FIELDS])


@query(
    f"""WITH i AS (SELECT p_partkey AS slug, p_size, {_ARCH_SQL}[1 + p_partkey % {len(_ARCHETYPES)}] AS archetype FROM part)
    SELECT slug, field FROM i JOIN {_DEMANDED} d(archetype, field) USING (archetype) WHERE (p_size + length(field)) % 3 = 0"""
)
def contract_keys(t: Tables):
    """Fields that items lack although their archetype demands them (items made up from parts: every third field is missing)."""
    fields = F.array(*[F.lit(f) for f in sorted({f for _, f, _ in banks.FIELD_CONTRACT})])
    have = F.filter(fields, lambda f: (F.col("p_size") + F.length(f)) % 3 != 0)
    names = F.array(*[F.lit(a) for a in _ARCHETYPES])
    items = t.part.select(
        F.col("p_partkey").alias("slug"), F.get(names, (F.col("p_partkey") % len(_ARCHETYPES)).cast("int")).alias("archetype"),
        F.map_from_entries(F.transform(have, lambda f: F.struct(f, F.lit("x")))).alias("archetype_fields"),
    )
    return contracts.missing_contract_keys(items)


@query(
    """WITH r AS (SELECT o_custkey AS chat, o_orderkey % 5 AS kind, '1.' || o_orderkey % 7 AS v FROM orders),
    m AS (SELECT v, count(*) AS mentions, count(DISTINCT chat) AS n_chats FROM r WHERE kind IN (0, 2, 3) GROUP BY 1),
    u AS (SELECT v, count(*) AS votes FROM r WHERE kind IN (1, 3) GROUP BY 1)
    SELECT v AS version, mentions::BIGINT AS mentions, n_chats, coalesce(votes, 0) AS unstable_votes FROM m LEFT JOIN u USING (v)"""
)
def doubtful_versions(t: Tables):
    """Versions of a product and the doubts about them, in texts that write its name in several ways (made up from orders)."""
    product = entities.Product("acme", "profile", "ACME", stem="profil")
    v = F.concat(F.lit("1."), F.col("o_orderkey") % 7)
    texts = [("We ship acme-profile-v", ".0 now."), ("The acme profils are out. v", " is unstable."), ("acme_profil ", " again"),
             ("Not yet. Do not approve acme profile v", "! We reject v{} too"), ("profil v", " is unstable")]
    kinds = [F.concat(F.lit(a), v, *([F.lit(b)] if "{}" not in b else [F.lit(b.split("{}")[0]), v, F.lit(b.split("{}")[1])])) for a, b in texts]
    said = F.get(F.array(*kinds), (F.col("o_orderkey") % 5).cast("int"))
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("chat_id"), F.col("o_orderkey").alias("pos"), F.lit("").alias("title"), said.alias("text"))
    return entities.versions(entities.mentions(rows, product)).select("version", "mentions", "n_chats", "unstable_votes")


# --- documents of open shape ----------------------------------------------


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 8 AS k, p_partkey % 3 + 1 AS n FROM part),
    f AS (
      SELECT p_partkey, '$: json' AS fault FROM p WHERE k = 7
      UNION ALL SELECT p_partkey, '$.state_id: pattern' FROM p WHERE k = 1
      UNION ALL SELECT p_partkey, unnest(['$.geometry_version: type', '$.extra: unknown']) FROM p WHERE k = 2
      UNION ALL SELECT p_partkey, unnest(['$.geometry_version: minimum', '$.observed_at: required']) FROM p WHERE k = 3
      UNION ALL SELECT p_partkey, '$.observations: minItems' FROM p WHERE k = 4
      UNION ALL SELECT p_partkey, unnest(['$.observations[' || i || '].value: maximum', '$.observations[' || i || '].evidence[1]: type']) FROM p, range(0, 3) r(i) WHERE k = 5 AND i < n
      UNION ALL SELECT p_partkey, unnest(['$.observations[' || i || '].coordinate: required', '$.observations[' || i || '].value: type']) FROM p, range(0, 3) r(i) WHERE k = 6 AND i < n
      UNION ALL SELECT p_partkey, '$.observation_role: enum' FROM p WHERE k = 6)
    SELECT * FROM f"""
)
def state_documents(t: Tables):
    """Every fault of project-state documents by its path (documents are written from part keys, valid and broken in seven ways)."""
    k, n = F.col("p_partkey") % 8, (F.col("p_partkey") % 3 + 1).cast("int")
    key = F.col("p_partkey").cast("string")
    seen = F.when(k == 5, F.lit('{"coordinate": "c.1", "value": 1.5, "evidence": ["a", 2]}')).when(k == 6, F.lit('{"value": "x"}')).otherwise(
        F.lit('{"coordinate": "c:2", "value": null, "evidence": []}'))
    observed = F.when(k == 4, F.lit("")).otherwise(F.array_join(F.array_repeat(seen, n), ", "))
    document = F.concat(
        F.lit('{"schema_version": "1.0.0", "state_id": "'), F.when(k == 1, F.lit("-")).otherwise(F.lit("s")), key, F.lit('", "project_ref": "p.'), key,
        F.lit('", "geometry_id": "g", "geometry_version": '), F.when(k == 2, F.lit("1.5")).when(k == 3, F.lit("0")).otherwise(F.lit("2")),
        F.lit(', "observation_role": "'), F.when(k == 6, F.lit("guess")).otherwise(F.lit("checkpoint")), F.lit('"'),
        F.when(k == 3, F.lit("")).otherwise(F.lit(', "observed_at": "2024-01-01"')), F.when(k == 2, F.lit(', "extra": {}')).otherwise(F.lit("")),
        F.lit(', "observations": ['), observed, F.when(k == 7, F.lit("]")).otherwise(F.lit("]}")))
    return contracts.document_faults(t.part.select("p_partkey", document.alias("document")), "p_partkey", "document", contracts.state_schema())


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k FROM part)
    SELECT p_partkey, unnest(CASE k WHEN 1 THEN ['$.n_samples: required'] WHEN 2 THEN ['$.n_samples: minimum', '$.duration_s: minimum']
      WHEN 3 THEN ['$.metrics.power_w.peak: required', '$.metrics.power_w.avg: type'] ELSE ['$.throttled: type'] END) AS fault FROM p WHERE k > 0"""
)
def telemetry_documents(t: Tables):
    """Every fault of telemetry summaries by its path (written from part keys)."""
    k = F.col("p_partkey") % 5
    power = F.when(k == 3, F.lit('{"min": 1, "avg": "2"}')).otherwise(F.lit('{"min": 1, "avg": 2.5, "peak": 3e2}'))
    document = F.concat(
        F.lit("{"), F.when(k == 1, F.lit("")).when(k == 2, F.lit('"n_samples": -1, ')).otherwise(F.concat(F.lit('"n_samples": '), F.col("p_partkey").cast("string"), F.lit(", "))),
        F.when(k == 2, F.lit('"duration_s": -0.5, ')).otherwise(F.lit('"duration_s": null, ')), F.when(k == 4, F.lit('"throttled": "no", ')).otherwise(F.lit("")),
        F.lit('"metrics": {"power_w": '), power, F.lit(', "temp_c": null}, "more": [1]}'))
    return contracts.document_faults(t.part.select("p_partkey", document.alias("document")), "p_partkey", "document", contracts.telemetry_schema())
