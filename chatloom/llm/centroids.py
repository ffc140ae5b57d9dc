"""Clustering of vectors around centroids, in exact integers and native expressions.

A vector's components become integers once and are stored. Each round is one scan:
``zip_with`` and ``aggregate`` give the squared distance to every centroid, a
literal array in the plan; ``array_min`` of (distance, number) structs chooses the
cluster, so ties go to the smaller number; sums of the components by cluster are
combined before the shuffle, and one row per cluster reaches the driver, which
divides and writes the next literals. Nothing else leaves the executors, whatever
the number of vectors.

Defined results: vectors that are null, of another length, or hold a null, a NaN or
an infinity are left out. Rows that share an id are vectors of their own; a null id
is kept and starts no cluster unless ids run out. Fewer vectors than clusters give
fewer clusters, none an empty table. Distances must fit in 64 bits: a component of
some 10^8 units after scaling (for 64 components) ends the job with an error that
says so, in place of a wrong number. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import stored

def whole(vectors: DataFrame, size: int, scale: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``vec_id``, ``q``) of the usable vectors, components scaled and floored to 64-bit integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))

    # Squared differences of twice this, one for each component, add up to 64 bits at most.
    largest = math.isqrt((2**63 - 1) // size) // 2 - 1

    def unit(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) <= largest, F.floor(scaled)).otherwise(
            F.raise_error(F.lit("a component is too large for distances of 64 bits")).cast("bigint"))

    return vectors.where(usable).select(F.col(id).alias("vec_id"), F.transform(vector, unit).alias("q"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose salted ids have the smallest digests, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(digest.asc_nulls_last(), "q").limit(clusters).select("q").collect()
    return [list(r.q) for r in chosen]


def nearest(centroids: list[list[int]]) -> Column:
    """Struct of ``distance`` and ``cluster`` of the nearest centroid to ``q``; ties go to the smaller number."""

    def to(k: int, centroid: list[int]) -> Column:
        fixed = F.array(*[F.lit(c).cast("bigint") for c in centroid])
        squares = F.zip_with("q", fixed, lambda a, b: (a - b) * (a - b))
        distance = F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, x: total + x)
        return F.struct(distance.alias("distance"), F.lit(k).alias("cluster"))

    return F.array_min(F.array(*[to(k, c) for k, c in enumerate(centroids)]))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the exact floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    assigned = rows.select(nearest(centroids)["cluster"].alias("cluster"), "q")
    sums = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row.cluster] = [total // row.n for total in row[2:]]
    return out


def cluster(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3,
    id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Per usable vector its cluster and distance, the distances summed, and the final centroid.

    ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` (its
    components). After ``rounds`` rounds the vectors are assigned once more.
    """
    rows = stored(whole(vectors, size, scale, id, vector))
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return rows.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.col("q").alias("centroid"))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    assigned = stored(rows.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"))
    # One row per cluster; the sums are decimals, so that they cannot wrap.
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}

    def of_cluster(values: dict[int, Column]) -> Column:
        return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), F.col("cluster"))

    return assigned.select(
        "vec_id", "cluster", "distance",
        of_cluster({k: F.lit(v).cast("bigint") for k, v in sums.items()}).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        of_cluster({k: F.array(*[F.lit(x).cast("bigint") for x in centroids[k]]) for k in sums}).alias("centroid"),
    )


def digest(centroid: Column) -> Column:
    """Lowercase SHA-256 of a centroid's components as decimal integers with commas between."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
