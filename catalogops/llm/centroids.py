"""Centroid clustering in whole numbers, with JVM-native expressions only.

A vector becomes an array of integers.  Every round places it at the nearest centroid: `zip_with` and `aggregate` give the squared
distances to the literal centroid arrays, `array_min` over (distance, number) structs chooses, and one sum per component and
cluster, combined on the map side, gives the new centroids.  Only these k rows of sums reach the driver; all arithmetic is exact, so
the result does not depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import keep

#: Scaled components are held within this bound, so that a squared distance of 64 components fits into a long.
BOUND = 1 << 27


def whole_vectors(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly `dims` components, none null or non-finite; v = floor(scale * x), held within BOUND."""
    x = F.col(vector).cast("array<double>")
    usable = (F.size(x) == dims) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    scaled = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))))
    return df.filter(F.col(vector).isNotNull()).filter(usable).select(F.col(vec_id).alias("vec_id"), scaled.cast("array<bigint>").alias("v"))


def whole_literal(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{int(x)}L' for x in values)})")


def squared_distance(v: Column, centroid: list[int]) -> Column:
    return F.aggregate(F.zip_with(v, whole_literal(centroid), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, d: total + d)


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid, the smaller number on ties."""
    return F.array_min(F.array(*[F.struct(squared_distance(v, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; rows with one id go by their components."""
    name = F.sha2(F.concat_ws(":", F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def fitted_centroids(vectors: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after `rounds` rounds of Lloyd's iteration with exact floor means; a cluster without vectors keeps its centroid."""
    for _ in range(rounds):
        placed = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
        sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(v[{i}]) AS c{i}") for i in range(len(centroids[0]))]).collect()
        moved = {r.cluster: [r[f"c{i}"] // r.n for i in range(len(centroids[0]))] for r in sums}
        new = [moved.get(i, c) for i, c in enumerate(centroids)]
        if new == centroids:
            break
        centroids = new
    return centroids


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and its final `centroid`.

    Vectors of another length, null vectors and those with a null or non-finite component are left out.  Fewer than k kept vectors
    give as many clusters; none gives no rows.  Rows repeated under one id are vectors of their own; a null id hashes as empty.
    Components beyond BOUND / scale count as that bound.  Other columns are not read.
    """
    vectors = keep(whole_vectors(df, vec_id, vector, dims, scale), "whole-vectors")
    schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<bigint>"
    start = first_centroids(vectors, k, seed)
    if not start:
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in schema.split(", "))])
    final = fitted_centroids(vectors, start, rounds)
    placed = vectors.select("vec_id", nearest(F.col("v"), final).alias("at")).select("vec_id", "at.cluster", "at.distance")
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def by_cluster(values: list, kind: str) -> Column:
        return F.array(*[F.lit(v).try_cast(kind) for v in values])[F.col("cluster")]

    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    total = F.lit(str(sum(inertia.values()))).try_cast("long")
    return placed.select(
        "vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", by_cluster([str(inertia.get(i, 0)) for i in range(len(final))], "long").alias("cluster_inertia"),
        total.alias("inertia"), by_cluster(hashes, "string").alias("centroid_sha256"),
        F.array(*[whole_literal(c) for c in final])[F.col("cluster")].alias("centroid"))
