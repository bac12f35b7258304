"""Centroid clustering in JVM expressions.

Each round is one pass over the staged integer vectors. zip_with and aggregate
give a vector's squared distances to the centroids, which stand in the plan as
literal arrays; array_min over (distance, number) structs picks the nearest, the
smaller number in a tie. Sums per component, one column each, are reduced before
the shuffle, so a round moves at most a row per cluster and task, whatever share
of the vectors one cluster or one repeated vector holds. Only the clusters' sums
(clusters x dims longs) come to the driver, where the division is exact.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listaro.llm.vectors import integer_vectors
from listaro.staging import drop_stage, read_table, stage

RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def _longs(values) -> str:
    return f"array({', '.join(f'{int(x)}L' for x in values)})"


def nearest(centroids: list[list[int]], v: str = "v") -> Column:
    """struct(distance, cluster) of the nearest centroid to the array column ``v``; of equally near ones that with the smaller number."""
    square = f"aggregate(zip_with({v}, {{}}, (a, b) -> (a - b) * (a - b)), 0L, (total, x) -> total + x)"
    each = [f"named_struct('distance', {square.format(_longs(c))}, 'cluster', {j})" for j, c in enumerate(centroids)]
    return F.expr(f"array_min(array({', '.join(each)}))")


def first_centroids(kept: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors whose id, salted, has the smallest SHA-256; rows without an id last, equal ids by their vectors."""
    place = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [list(r.v) for r in kept.select(place.alias("place"), "v").orderBy(F.asc_nulls_last("place"), "v").limit(clusters).collect()]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of the vectors nearest to each; one without vectors stays."""
    dims = range(len(centroids[0]))
    sums = kept.select("v", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in dims])
    new = [list(c) for c in centroids]
    for r in sums.collect():
        new[r.cluster] = [r[f"s{i}"] // r.n for i in dims]
    return new


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, salt: str = "3:") -> DataFrame:
    """Lloyd's algorithm in integers: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector.

    A round that moves no centroid ends the rounds, as all further ones would
    change nothing either.

    Defined cases: vectors that are null, of another length or hold a null or
    non-finite component are left out; fewer kept vectors than clusters start as
    many centroids; rows without an id are clustered, but start a centroid only
    where too few others do; repeated rows and ids count and are returned each;
    an empty table gives an empty result; other columns are not looked at,
    whatever their names; components whose distances do not fit a long stop the job.
    """
    kept = stage(integer_vectors(vectors, id_col, vec_col, scale, dims), "centroid-vectors", rebalance=False)
    centroids = first_centroids(kept, clusters, salt)
    if not centroids:
        return kept.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        before, centroids = centroids, moved(kept, centroids)
        if before == centroids:
            break
    found = stage(kept.select("id", nearest(centroids).alias("near")).select("id", "near.cluster", "near.distance"), "centroid-assigned", rebalance=False)
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    drop_stage(kept)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        F.expr(_longs([inertia.get(j, 0) for j in range(len(centroids))]))[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.array(*map(F.lit, shas))[F.col("cluster")].alias("centroid_sha256"),
    )


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """Eight clusters after ten rounds; the cases are defined as in ``clustered``."""
    return clustered(read_table(spark, f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _round_sql(n: int) -> str:
    return f"""
a{n} AS MATERIALIZED (SELECT k.uid, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT, j := c.j)) AS near FROM kept k, c{n} c GROUP BY k.uid),
u{n} AS MATERIALIZED (SELECT a.near.j AS j, i, sum(k.v[i]) AS s, count(*) AS n FROM a{n} a JOIN kept k USING (uid), range(1, 65) r(i) GROUP BY ALL),
m{n} AS MATERIALIZED (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM u{n} GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (j)),"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS j, v FROM kept ORDER BY j LIMIT 8),
{"".join(_round_sql(n) for n in range(10))}
last AS MATERIALIZED (SELECT k.uid, k.vec_id, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT, j := c.j)) AS near FROM kept k, c10 c GROUP BY ALL)
SELECT vec_id, near.j AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.j))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last JOIN c10 c ON c.j = near.j
"""
