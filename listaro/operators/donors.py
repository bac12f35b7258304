"""Donor assignment and the growing reuse estimate: both are loops over ordered rows, restated as joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listaro.operators import joins as J
from listaro.staging import drop_stage, stage

#: Degrees of latitude, and half those of longitude, that a block of the growing estimate spans.
BLOCK = 0.05


def assign_donors(rows: DataFrame, candidates: DataFrame, radius_m: float) -> DataFrame:
    """(id, donor_id) of rows that get a donor, as if rows were handled one by one in ``ord``.

    rows: id, lat, lng, ord, donor. candidates: peer_id, peer_lat, peer_lng, rank
    and ord (null for candidates that are never handled, which come last).

    A candidate leaves the pool when it is handled itself and a later candidate
    is near. A row without a pointer takes the nearest candidate that is still
    in the pool at its turn. A pointer to a row that got one in this pass moves
    on to that row's donor, also a pointer that was there before.
    """
    at, last = ["lat", "lng"], F.lit(2**62)
    there = "peer_lat is not null and peer_lng is not null"
    pool = candidates.filter(there).withColumn("peer_ord", F.coalesce("ord", last)).drop("ord")
    # Rows at one place have the same neighbours, so the last candidate of each place tells who has a later one near.
    lasts = pool.groupBy("peer_lat", "peer_lng").agg(F.max("peer_ord").alias("peer_last"))
    near = J.radius_join(lasts.toDF("lat", "lng", "own_last").drop("own_last"), lasts, radius_m).groupBy(*at).agg(F.max("peer_last").alias("near_last"))
    judged = pool.join(near.toDF("peer_lat", "peer_lng", "near_last"), ["peer_lat", "peer_lng"]).withColumn("evicted", (F.col("peer_ord") < last) & (F.col("near_last") > F.col("peer_ord")))
    judged = stage(judged.drop("near_last"), "donors-pool")
    free = rows.filter(F.coalesce(F.trim("donor"), F.lit("")) == "").filter("lat is not null and lng is not null").select("id", "lat", "lng", "ord")
    staying = J.nearest_ranked(free, judged.filter("not evicted"), radius_m).withColumnRenamed("donor_id", "peer_id")
    found = staying.unionByName(_nearest_leaving(free, judged.filter("evicted"), radius_m))
    links = stage(found.groupBy("id").agg(F.min_by("peer_id", F.struct("dist", "rank", "peer_id")).alias("target")), "donors-links")
    held = rows.filter(F.coalesce(F.trim("donor"), F.lit("")) != "").select("id", F.trim("donor").alias("target"))
    moved = held.join(links.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target")
    # Only links made in this pass are followed.
    return J.chain_roots(links.unionByName(moved)).select("id", F.col("root").alias("donor_id"))


def _nearest_leaving(free: DataFrame, leaving: DataFrame, radius_m: float) -> DataFrame:
    """(id, peer_id, dist, rank): the nearest candidate that leaves the pool after the row's turn, for rows (id, lat, lng, ord).

    Seen from a place, a place further off counts only for turns before which all nearer ones are empty:
    each row has one distance, and at that the least rank of those whose turn comes later.
    """
    at = ["lat", "lng"]
    lasts = leaving.groupBy("peer_lat", "peer_lng").agg(F.max("peer_ord").alias("peer_last"))
    met = J.radius_join(free.select(*at).distinct(), lasts, radius_m)
    rings = met.groupBy(*at, "dist").agg(F.max("peer_last").alias("until"), F.collect_list(F.struct("peer_lat", "peer_lng")).alias("places"))
    nearer = F.max("until").over(Window.partitionBy(*at).orderBy("dist").rowsBetween(Window.unboundedPreceding, -1))
    steps = rings.withColumn("since", nearer).filter("since is null or until > since")
    asks = free.join(steps, at).filter("ord < until and (since is null or ord >= since)").select("id", "ord", "dist", F.explode("places").alias("p"))
    asks = asks.select("p.peer_lat", "p.peer_lng", "ord", F.lit(0).alias("given"), "id", "dist")
    gives = leaving.select("peer_lat", "peer_lng", F.col("peer_ord").alias("ord"), F.lit(1).alias("given"), F.struct("rank", "peer_id").alias("x"))
    # From the last turn to the first; a row stands before the candidates of its own turn.
    so_far = Window.partitionBy("peer_lat", "peer_lng").orderBy(F.col("ord").desc(), "given").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asks.unionByName(gives, allowMissingColumns=True).withColumn("x", F.min("x").over(so_far))
    return both.filter("given = 0 and x is not null").select("id", F.col("x.peer_id").alias("peer_id"), "dist", F.col("x.rank").alias("rank"))


def _settler():
    # Inside a function, so that it travels by itself to machines without this package.
    def settled(pairs):
        """(id, calls) of the places of one block that what is known settles, in order; pairs: ord, id, peer_id, calls of the peer or null."""
        found: dict = {}
        for (_, place), peers in pairs.groupby(["ord", "id"], sort=True):
            calls = [found.get(p, None if c is None or c != c else bool(c)) for p, c in zip(peers["peer_id"], peers["calls"])]
            if any(calls):
                found[place] = False
            elif None not in calls:
                found[place] = True
        return pd.DataFrame({"id": list(found), "calls": list(found.values())}).astype({"id": object, "calls": bool})

    return settled


def estimate_growing(rows: DataFrame, radius_m: float) -> DataFrame:
    """(id, calls) where each row that finds no earlier caller near has to call, and can then be reused by later ones.

    Only the first row of a place can call: whoever it reuses is near the later ones too.
    In rounds: each block of the map settles its places in order, as far as what it knows of
    other blocks goes, so a line of neighbours takes a round for each block that it enters. Rows without coordinates always call, and give nothing; rows with a pointer never do.
    """
    at = ["lat", "lng"]
    free = rows.filter(F.coalesce(F.trim("donor"), F.lit("")) == "")
    placed = free.filter("lat is not null and lng is not null")
    places = stage(placed.filter("ord is not null").groupBy(*at).agg(F.min("ord").alias("ord"), F.min_by("id", F.struct("ord", "id")).cast("string").alias("id")), "growing-places")
    peers = places.select(F.col("id").alias("peer_id"), F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng"), F.col("ord").alias("peer_ord"))
    block = F.xxhash64(F.floor(F.col("lat") / BLOCK), F.floor(F.col("lng") / (2 * BLOCK)))
    before = stage(J.radius_join(places, peers, radius_m).filter("peer_ord < ord").select(block.alias("block"), "ord", "id", "peer_id"), "growing-pairs")
    known = stage(places.join(before.select("id"), "id", "left_anti").select("id", F.lit(True).alias("calls")), "growing-known")
    while not before.isEmpty():  # the earliest open place is always settled, so each round settles some
        seen = before.join(known.select(F.col("id").alias("peer_id"), "calls"), "peer_id", "left")
        new = stage(seen.select("block", "ord", "id", "peer_id", "calls").groupBy("block").applyInPandas(_settler(), "id string, calls boolean"), "growing-new")
        left = stage(before.join(new, "id", "left_anti"), "growing-pairs")
        so_far = stage(known.unionByName(new), "growing-known")
        for table in (before, new, known):
            drop_stage(table)
        before, known = left, so_far
    first = places.select("lat", "lng", F.col("ord").alias("first_ord"), "id")
    first = first.join(known.filter("calls"), "id", "left_semi").drop("id")
    settled = placed.join(first, at, "left").select("id", (F.col("ord").isNull() | F.coalesce(F.col("ord") == F.col("first_ord"), F.lit(False))).alias("calls"))
    unplaced = free.filter("lat is null or lng is null").select("id", F.lit(True).alias("calls"))
    return settled.unionByName(unplaced).unionByName(rows.filter(F.coalesce(F.trim("donor"), F.lit("")) != "").select("id", F.lit(False).alias("calls")))
