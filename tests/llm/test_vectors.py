"""Vector operators against plain Python replays."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listaro.llm import centroids, code_tree, vector_codes

NAN = float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, "v", "i", "c") for i, x, label in rows], SCHEMA)


def some(n, dims, seed=0, hot=0.3):
    """Vectors of which a share is one and the same, and others lie on a coarse grid, so that ties are many."""
    r = random.Random(seed)
    one = [r.randrange(-4, 5) / 8 for _ in range(dims)]
    return [(i, one if r.random() < hot else [r.randrange(-4, 5) / 8 for _ in range(dims)], r.choice([None, 1, 2])) for i in range(n)]


def lloyd(points, start, rounds):
    centres = [list(c) for c in start]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for p in points:
            members.setdefault(near(p)[1], []).append(p)
        centres = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centres)]
    return centres, [near(p) for p in points]


@pytest.mark.parametrize("n", [1, 5, 300])
def test_clusters_match_a_replay(spark, n):
    rows = some(n, 4)
    odd = [(900, None, 1), (901, [0.5] * 3, 1), (902, [0.5, None, 0.5, 0.5], 1), (903, [NAN, 0.5, 0.5, 0.5], 1), (904, [float("inf"), 0.5, 0.5, 0.5], 1), (905, [], 1)]
    rows += [rows[0], rows[-1]]
    got = sorted(centroids.clustered(vectors(spark, rows + odd), dims=4, clusters=6, rounds=4).collect())
    points = [[int(x * 1024) for x in v] for _, v, _ in rows]
    start = [p for _, p in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), p) for (i, _, _), p in zip(rows, points))][:6]
    centres, near = lloyd(points, start, 4)
    sums = {j: sum(d for d, k in near if k == j) for _, j in near}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert got == sorted((i, j, d, sums[j], sum(sums.values()), sha[j]) for (i, _, _), (d, j) in zip(rows, near))


def test_cluster_cases(spark):
    assert centroids.clustered(vectors(spark, []), dims=4).count() == 0
    assert centroids.clustered(vectors(spark, [(1, None, 1)]), dims=4).count() == 0
    lonely = centroids.clustered(vectors(spark, [(None, [0.5, 0.5], 1), (None, [0.5, 0.5], 1), (7, [-0.5, 0.0], None)]), dims=2, clusters=2).collect()
    assert sorted((r.vec_id is None, r.cluster, r.distance) for r in lonely) == [(False, 0, 0), (True, 1, 0), (True, 1, 0)]
    with pytest.raises(Exception, match="not below"):
        centroids.clustered(vectors(spark, [(1, [1e20, 0.0], 1)]), dims=2).collect()


def test_floors_go_down(spark):
    got = centroids.clustered(vectors(spark, [(1, [-0.25, 0.0], 1), (2, [-0.375, 0.0], 1)]), dims=2, clusters=1, rounds=3, scale=8).collect()
    assert {r.centroid_sha256 for r in got} == {hashlib.sha256(b"-3,0").hexdigest()}


def test_a_tie_goes_to_the_smaller_number(spark):
    rows = spark.createDataFrame([([4, 0],), ([5, 0],)], "v array<bigint>")
    got = rows.select(centroids.nearest([[8, 0], [0, 0], [8, 0]]).alias("n")).select("n.*").collect()
    assert [(r.distance, r.cluster) for r in got] == [(16, 0), (9, 0)]


@pytest.mark.parametrize("n,k,spread", [(1, 1, 3), (7, 3, 2), (40, 16, 1), (700, 16, 40), (700, 5, 2), (2000, 16, 1000)])
def test_dual_tree_search_matches_all_distances(n, k, spread):
    r = np.random.default_rng(n + k)
    middle = r.integers(-5 * spread, 5 * spread, (3, 8, 4))
    points = middle[:, r.integers(0, 8, n)] + r.integers(-spread, spread + 1, (3, n, 4))
    points[:, : n // 3] = points[:, :1]  # a third is one point
    entries = points[:, r.integers(0, n, k)]  # equal entries among them
    trees, books = code_tree.point_forest(points), code_tree.entry_forest(entries)
    want = np.argmin(((points[:, :, None] - entries[:, None]) ** 2).sum(3), axis=2)  # the first of equally near ones
    assert np.array_equal(code_tree.codes(trees, books), want)
    counts, sums = code_tree.totals(trees, books)
    for p in range(3):
        for e in range(k):
            assert counts[p, e] == (want[p] == e).sum() and np.array_equal(sums[p, e], points[p][want[p] == e].sum(0))


def test_whole_nodes_take_their_kept_sums():
    """Well apart, whole nodes are assigned: hardly a point is looked at by itself."""
    r = np.random.default_rng(1)
    middle = r.integers(-100_000, 100_000, (1, 8, 4))
    points = middle[:, np.sort(r.integers(0, 8, 3000))] + r.integers(-9, 10, (1, 3000, 4))
    nodes, rest = code_tree.nearest(code_tree.point_forest(points), code_tree.entry_forest(middle))
    assert len(nodes) > 0 and sum(len(places) for _, places, _ in rest) < 300


@pytest.mark.parametrize("n", [1, 9, 400])
def test_codes_match_a_replay(spark, n):
    rows = some(n, 4, seed=3)
    odd = [(900, None, 1), (901, [0.5] * 3, 1), (902, [0.5, None, 0.5, 0.5], 1), (903, [NAN, 0.5, 0.5, 0.5], 1), (905, [], 1)]
    rows += [rows[0], rows[-1], (None, rows[0][1], None)]
    found, books = vector_codes.compressed(vectors(spark, rows + odd), positions=2, entries=6, rounds=3, scale=8, dims=4)
    points = [[int(x * 8) for x in v] for _, v, _ in rows]
    start = [p for _, p in sorted(((i if i is not None else 10**9, p) for (i, _, _), p in zip(rows, points)))][:6]
    replays = [lloyd([p[a : a + 2] for p in points], [p[a : a + 2] for p in start], 3) for a in (0, 2)]
    assert books.tolist() == [c for c, _ in replays]
    want = [(i, label, f"{x[1]:02x}{y[1]:02x}", x[0] + y[0]) for (i, _, label), x, y in zip(rows, replays[0][1], replays[1][1])]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.collect())


def test_code_cases(spark):
    found, books = vector_codes.compressed(vectors(spark, []), dims=8)
    assert found.count() == 0 and books.size == 0
    texts, _ = vector_codes.compressed(vectors(spark, [(1, [0.5] * 8, 1)]).withColumn("label", F.lit("x")).withColumn("label_", F.lit(1)), dims=8)
    assert [tuple(r) for r in texts.collect()] == [(1, "x", "00" * 8, 0)]
