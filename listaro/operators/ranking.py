"""Priorities, budgets and bounded work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listaro.config import CONFIG, Config
from listaro.functions import scalars as S
from listaro.operators import joins as J


def classification_order(listings: DataFrame, geo: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """``id`` with ``tier`` (open, other, sold) and ``band`` (fits, unknown, misses) by size and donor-resolved commutes."""
    rows = listings.join(J.resolve_donor(geo).select("id", "brj", "mvv"), "id", "left")
    s, area = S.status_key("status"), F.coalesce("bra_total", "bra_primary", "bra_i")
    tier = F.when(s == "solgt", 2).when(F.col("active") & ~s.isin(*cfg.closed), 0).otherwise(1)
    miss = (area < cfg.fit_area) | (F.col("brj") > cfg.fit_minutes) | (F.col("mvv") > cfg.fit_minutes)
    fits = (area >= cfg.fit_area) & F.col("brj").between(0, cfg.fit_minutes) & F.col("mvv").between(0, cfg.fit_minutes)
    return rows.select("id", tier.alias("tier"), F.when(F.coalesce(miss, F.lit(False)), 2).when(F.coalesce(fits, F.lit(False)), 0).otherwise(1).alias("band"))


def sale_targets(listings: DataFrame, geo: DataFrame, sold: DataFrame, attempts: DataFrame, as_of: Column, cfg: Config = CONFIG) -> DataFrame:
    """Closed listings that still lack a sale price: all sold ones, and inactive ones within the grace period, if old enough and not given up."""
    rows = listings.join(geo.filter("lat is not null and lng is not null").select("id", "lat", "lng"), "id")
    rows = rows.join(sold.select("id", "sold_price"), "id", "left").join(attempts, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    s, updated = S.status_key("status"), F.col("updated_at").cast("timestamp")
    within = (s == "solgt") | ((s == "inaktiv") & (updated >= as_of - F.make_dt_interval(F.lit(cfg.grace_days))))
    old = updated < as_of - F.make_dt_interval(F.lit(cfg.min_age_days))
    return rows.filter(within & old & F.col("sold_price").isNull() & (F.col("attempts") < cfg.max_attempts)).select("id", "lat", "lng", s.alias("status"), "attempts")


def with_density(targets: DataFrame, pad_lat: float = 0.01, pad_lng: float = 0.02) -> DataFrame:
    """Each target with the number of targets in its box (itself included); boxes meet by cells of the box's half size."""
    cell_y, cell_x = F.floor(F.col("lat") / pad_lat), F.floor(F.col("lng") / pad_lng)
    peers = targets.select(cell_y.alias("cy"), cell_x.alias("cx"), F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), y -> transform(sequence(-1, 1), x -> struct(y AS y, x AS x))))"))
    own = targets.withColumn("o", around).withColumn("cy", cell_y + F.col("o.y")).withColumn("cx", cell_x + F.col("o.x")).drop("o")
    inside = own.join(peers, ["cy", "cx"]).filter((F.abs(F.col("plat") - F.col("lat")) <= pad_lat) & (F.abs(F.col("plng") - F.col("lng")) <= pad_lng))
    return inside.groupBy("id", "lat", "lng", "status", "attempts").agg(F.count("*").alias("density"))


def allocate_budget(targets: DataFrame, budget: int, reserve: int) -> DataFrame:
    """Targets that a request budget reaches, sold ones first; a reserve is kept for inactive ones if there are any.

    Only the budget's rows are ranked in one task: each tier is cut by a top-k first.
    """
    order = [F.col("attempts"), F.col("density").desc(), F.col("id").cast("long")]
    sold, other = targets.filter("status = 'solgt'"), targets.filter("status != 'solgt'")
    cap = min(max(1, budget - reserve), budget) if not other.isEmpty() else budget
    first = sold.orderBy(*order).limit(cap)
    used = first.count()
    rest = other.orderBy(*order).limit(max(0, budget - used))
    return first.unionByName(rest)


def select_work(candidates: DataFrame, cached: DataFrame, limit: int) -> DataFrame:
    """Cache hits without limit, and the first ``limit`` of the rest by (tier, band, id)."""
    hits = candidates.join(cached, "id", "left_semi").select("id", F.lit("hit").alias("kind"))
    paid = candidates.join(cached, "id", "left_anti").orderBy("tier", "band", F.col("id").cast("long")).limit(limit).select("id", F.lit("paid").alias("kind"))
    return hits.unionByName(paid)


def limit_calls(rows: DataFrame, destinations: tuple[str, ...], n: int) -> DataFrame:
    """The first n calls for unknown values, by row and destination; a row may be cut between two calls. 0 is no limit."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("destination"), F.col(c).alias("value")) for i, c in enumerate(destinations)]))
    wanted = rows.select("id", pairs.alias("p")).filter("p.value is null").select("id", "p.at", "p.destination")
    return (wanted.orderBy(F.col("id").cast("long"), "at").limit(n) if n else wanted).select("id", "destination")


def assign_cards(cards: DataFrame, targets: DataFrame) -> DataFrame:
    """Each sale card once, by its first request: matched to its own target, or a neighbour of the request's target."""
    first = J.first_per_key(cards, ["card_id"], "request_no")
    known = targets.select(F.col("id").alias("card_id"), F.lit(True).alias("own"))
    return first.join(known, "card_id", "left").select("card_id", F.when(F.col("own"), "matched").otherwise("neighbour").alias("kind"), F.when(F.col("own").isNull(), F.col("request_id")).alias("near_id"))
