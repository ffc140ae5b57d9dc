"""Queries that cluster: connected components over shared lines and shared customers."""

from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import clusters
from chatloom.queries.base import Tables, query

_SQL_LINKS = """
l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, E'\\n')), '^\\s+|\\s+$', '', 'g') AS line FROM documents)
      WHERE line <> ''),
g AS (SELECT line FROM l GROUP BY line HAVING count(*) BETWEEN 2 AND 12),
k AS (SELECT doc_id, line FROM l JOIN g USING (line)),
h AS (SELECT line, min(doc_id) AS hub FROM k GROUP BY line),
e AS (SELECT DISTINCT doc_id AS a, hub AS b FROM k JOIN h USING (line) WHERE doc_id <> hub)"""


@query(
    f"""WITH RECURSIVE {_SQL_LINKS},
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT DISTINCT a AS d, a AS m FROM b UNION SELECT b.b, r.m FROM reach r JOIN b ON b.a = r.d)
    SELECT doc_id, coalesce(m, doc_id) AS cluster_id FROM documents LEFT JOIN (SELECT d, min(m) AS m FROM reach GROUP BY d) ON d = doc_id"""
)
def connected_components(t: Tables):
    """Documents connected through shared lines, whatever their length; a line that more than ``MERGE_CAP`` (12) documents share does not connect."""
    lines = (
        t.documents.select("doc_id", F.explode(F.transform(F.split("text", "\n"), T.strip)).alias("slug"))
        .where(F.col("slug") != "")
        .select("doc_id", F.sha2("slug", 256).alias("slug"))
        .distinct()
    )
    none = lines.where("false").withColumn("is_version", F.lit(True)).withColumnRenamed("doc_id", "conv_id")
    links = clusters.edges(lines.withColumnRenamed("doc_id", "conv_id"), none, merge_cap=clusters.MERGE_CAP)
    heads = t.documents.select(F.col("doc_id").alias("conv_id"))
    return clusters.members(heads, clusters.components(links)).select(F.col("conv_id").alias("doc_id"), "cluster_id")


@query(
    """WITH w AS (SELECT p_brand, lower(unnest(string_split(p_name, ' '))) AS keyword, generate_subscripts(string_split(p_name, ' '), 1) AS i, p_partkey FROM part),
    n AS (SELECT p_brand, keyword, count(*) AS n, min((p_partkey, i)) AS f FROM w WHERE keyword <> '' GROUP BY 1, 2)
    SELECT p_brand AS cluster_id, keyword, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS rank FROM n QUALIFY rank <= 10"""
)
def top_keywords(t: Tables):
    """Most common title keywords per cluster (brand)."""
    rows = t.part.select(
        F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("conv_id"), F.lit(0.0).alias("create_time"),
        T.title_keywords(F.col("p_name")).alias("title_keywords"),
    )
    return clusters.top_keywords(rows).withColumn("rank", F.col("rank").cast("bigint"))
