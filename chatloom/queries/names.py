"""Queries over names and heads: archive and file names, slug votes, last nodes, models and attachments.

No table holds such names, so they are written from keys of the given tables; the SQL
works out what must come back from the same keys, not from the names.
"""

from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import cards, conversations as C
from chatloom.queries.base import Tables, query


def _pick(kind, *values):
    """The value of the place ``kind``."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), kind + 1)


@query(
    """SELECT o_orderkey,
      CASE o_orderkey % 8 WHEN 0 THEN 'team-x' || o_custkey WHEN 1 THEN 'app' || o_custkey WHEN 2 THEN 'demo-c' || o_custkey WHEN 3 THEN ''
        WHEN 4 THEN (o_custkey % 9999)::VARCHAR WHEN 5 THEN 'model-123456-x' || o_custkey WHEN 6 THEN 'caf-app' ELSE 'my-arena' END AS slug,
      CASE o_orderkey % 8 WHEN 2 THEN '1.' || (o_custkey % 20) || '.0' WHEN 6 THEN (o_custkey % 9)::VARCHAR END AS version,
      o_orderkey % 8 NOT IN (3, 4) AS is_version, CASE o_orderkey % 8 WHEN 0 THEN '2024-01-0' || (o_custkey % 9 + 1) END AS exported
    FROM orders"""
)
def archive_names(t: Tables):
    """Slug, version, kind and export date of archive names of eight shapes."""
    c = F.col("o_custkey").cast("string")
    small = lambda n: (F.col("o_custkey") % n).cast("string")
    name = _pick(
        (F.col("o_orderkey") % 8).cast("int"),
        F.concat(F.lit("Team_x"), c, F.lit("-2024-01-0"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("-final.ZIP")),
        F.concat(F.lit("app"), c, F.lit("_20240105-120000.zip")),
        F.concat(F.lit("demo-c"), c, F.lit("-v1_"), small(20), F.lit("_0.zip")),
        F.concat(F.substring(F.md5(c), 1, 16), F.lit(".zip")),
        F.concat(small(9999), F.lit(".zip")),
        F.concat(F.lit("model-123456-x"), c, F.lit(".zip")),
        F.concat(F.lit("café app v"), small(9), F.lit(".zip")),
        "My.Arena 2024_06_20.Zip",
    )
    rows = t.orders.select("o_orderkey", name.alias("name"))
    return rows.select(
        "o_orderkey", T.archive_slug(F.col("name")).alias("slug"), T.archive_version(F.col("name")).alias("version"),
        T.is_version_archive(F.col("name")).alias("is_version"), T.export_date(T.base_name(F.concat(F.lit("C:\\in/"), "name"))).alias("exported"))


_ENDINGS = [".py", ".MD", ".json", ".ipynb", ".cfg", ".xyz", "", ".sql", ".Yaml", ".tar.txt", ".h", "csv"]
_CLASSES = ["code", "doc", "data", "notebook", "config", "other", "other", "code", "data", "doc", "code", "other"]


@query(f"SELECT o_custkey AS conv_id, ({_CLASSES!r})[o_orderkey % 12 + 1] AS ext_class, count(*) AS n FROM orders GROUP BY ALL")
def file_class_counts(t: Tables):
    """Files per class of every conversation (customers hold files named after their orders)."""
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), _pick((F.col("o_orderkey") % 12).cast("int"), *_ENDINGS))
    return cards.file_classes(t.orders.select(F.col("o_custkey").alias("conv_id"), T.extension_class(name).alias("ext_class")))


@query(
    """WITH v AS (
      SELECT o_custkey AS conv_id, 's-' || lower(o_orderstatus) AS slug, 3 AS w FROM orders WHERE o_orderkey % 3 <> 0
      UNION ALL SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 's-f' ELSE 'other-' || o_custkey END, 1 FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT conv_id::VARCHAR AS conv_id, slug, sum(w)::BIGINT AS votes FROM v GROUP BY 1, 2"""
)
def slug_votes(t: Tables):
    """Votes for the slug of each conversation: three per release archive, one for the title."""
    conv = F.col("o_custkey").cast("string").alias("conv_id")
    archives = t.orders.select(
        conv, F.concat(F.lit("s-"), F.lower("o_orderstatus")).alias("slug"), (F.col("o_orderkey") % 3 != 0).alias("is_version"),
        F.col("o_orderkey").cast("bigint").alias("turn_pos"), F.lit(0).alias("at"))
    title = F.when(F.col("o_custkey") % 2 == 0, F.lit(" S: F ")).otherwise(F.concat(F.lit("Other #"), F.col("o_custkey").cast("string")))
    heads = t.orders.select("o_custkey").distinct().select(conv, title.alias("title"))
    return cards.slug_votes(archives, heads).select("conv_id", "slug", F.col("votes").cast("bigint").alias("votes"))


@query(
    """WITH n AS (SELECT conv_id, turn, CASE WHEN turn % 11 = 10 THEN 0 ELSE turn * 7 % 5 END AS t FROM conversations),
    f AS (SELECT conv_id, arg_max(turn, (t, turn)) AS turn FROM n WHERE turn % 3 = 0 GROUP BY 1)
    SELECT c.conv_id::VARCHAR AS conv_id, coalesce(CASE WHEN c.conv_id % 4 = 0 AND c.has THEN '1' END, f.turn::VARCHAR) AS node_id
    FROM (SELECT conv_id, bool_or(turn = 1) AS has FROM conversations GROUP BY 1) c LEFT JOIN f USING (conv_id)
    WHERE (c.conv_id % 4 = 0 AND c.has) OR f.turn IS NOT NULL"""
)
def last_nodes(t: Tables):
    """The node each conversation ends on: the current one where it exists, else the latest without children, the last listed of equal times."""
    conv = F.col("conv_id").cast("string").alias("conv_id")
    time = F.when(F.col("turn") % 11 != 10, F.concat(F.lit('{"create_time": '), (F.col("turn") * 7 % 5).cast("string"), F.lit(".0}")))
    nodes = t.conversations.select(
        conv, F.col("turn").alias("pos"), F.col("turn").cast("string").alias("node_id"), F.when(F.col("turn") % 3 == 0, 0).otherwise(1).alias("n_children"), time.alias("message"))
    heads = t.conversations.select("conv_id").distinct().select(
        conv, F.when(F.col("conv_id") % 4 == 0, F.lit("1")).when(F.col("conv_id") % 4 == 1, F.lit("missing")).alias("current_node"))
    return C.leaves(heads, nodes)


@query(
    """SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'm' || conv_id WHEN 3 THEN 'd2' END AS model,
      'a' || turn || '.pdf|f' || turn || '|b|g' AS attachments FROM conversations"""
)
def message_models(t: Tables):
    """The model that wrote a message, or its default, and attachment names: the name, else the id; bare strings too."""
    meta = _pick(
        (F.col("turn") % 4).cast("int"), F.concat(F.lit('"model_slug": "m'), F.col("conv_id").cast("string"), F.lit('", "default_model_slug": "d0"')),
        '"model_slug": " ", "default_model_slug": "d1"', '"model_slug": null', '"model_slug": 5, "default_model_slug": "d2"')
    turn = F.col("turn").cast("string")
    message = F.concat(
        F.lit('{"author": {"role": "'), F.col("role"), F.lit('"}, "content": {}, "metadata": {'), meta, F.lit(', "attachments": [{"name": " a'), turn,
        F.lit('.pdf "}, {"id": "f'), turn, F.lit('"}, "b", {}, "", " ", {"name": "", "id": "g"}, 7]}}'))
    rows = C.read_messages(t.conversations.select("conv_id", "turn", message.alias("message")))
    return rows.select("conv_id", "turn", "role", "model", F.array_join("attachments", "|").alias("attachments"))
