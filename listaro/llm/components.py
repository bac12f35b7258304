"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.staging import drop_stage, stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_min(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (u, v, m), minima): m is the least of u and its neighbours. The minima are staged, so that a hub's edges can be split."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("least")), "cc-least", rebalance=False)
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m")), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v; any order, repeats allowed).

    root is the smallest node of the component. Each round moves a few longs per
    edge; the number of rounds grows with the logarithm of the longest path. All
    staged tables come out of an exchange, so they are not dealt once more.
    """
    edges = stage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges", rebalance=False)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, met_least = _with_min(both)
        large = stage(met.filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large", rebalance=False)
        pointed, pointed_least = _with_min(large)
        small = stage(
            pointed.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pointed.select("u", F.col("m").alias("v"))).distinct(),
            "cc-small",
            rebalance=False,
        )
        for table in (edges, large, met_least, pointed_least):
            drop_stage(table)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
