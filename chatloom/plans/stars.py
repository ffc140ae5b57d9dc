"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of the edges (a, b): the smallest node reachable.

    Alternating large-star and small-star steps: every node is re-linked to the
    smallest node around it until each component is a star. A step aggregates and
    joins, so no list of neighbours and no pair of neighbours is ever built; a path
    of n nodes takes about log n steps. Steps are written to the shared folder, and
    only settled edges are compared to find the end.
    """
    a, b = F.col("a"), F.col("b")
    links = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            return links.select(a.alias("node"), b.alias("component")).union(links.select(b, b)).distinct()
        seen = state
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        pair = lambda x: F.struct(x.alias("a"), F.col("low").alias("b"))
        small = large.join(least, "a").select(F.explode(F.array(pair(a), pair(b))).alias("e"))
        links = cut(small.select("e.*").where(a != b).distinct())
