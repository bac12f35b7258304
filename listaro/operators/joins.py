"""Joins of the listing domain: star, donor values, cross-source match, radius and lifecycle joins."""

from __future__ import annotations

from math import cos, degrees, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listaro.functions import scalars as S


def first_per_key(df: DataFrame, keys: list, *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def listing_base(listings: DataFrame, *sides: DataFrame) -> DataFrame:
    """Left star join on id."""
    for side in sides:
        listings = listings.join(side, "id", "left")
    return listings


def resolve_donor(geo: DataFrame, columns: tuple[str, ...] = ("brj", "mvv")) -> DataFrame:
    """Travel values by a single hop: the donor's where the pointer is not blank and the donor has one.

    Rows without a pointer, the most, stay out of the join: they would all meet in one task.
    """
    source = geo.select(F.col("id").alias("donor"), *[F.col(c).alias(f"src_{c}") for c in columns])
    pointed = F.coalesce(F.trim("donor"), F.lit("")) != ""
    values = {c: F.coalesce(f"src_{c}", c) for c in columns}
    found = geo.filter(pointed).join(source, "donor", "left").withColumns(values).drop(*[f"src_{c}" for c in columns])
    return found.unionByName(geo.filter(~pointed))


def match_sources(b: DataFrame, a: DataFrame, order: Column) -> DataFrame:
    """``b`` with the id of the first listing of ``a`` (in ``order``) that has its address and postcode key, or null."""
    keyed = a.select(S.address_key("adresse").alias("a_key"), S.postcode_key("postnummer").alias("p_key"), "id", order.alias("ord"))
    firsts = keyed.groupBy("a_key", "p_key").agg(F.min_by("id", "ord").alias("match_id"))
    return b.withColumn("a_key", S.address_key("adresse")).withColumn("p_key", S.postcode_key("postnummer")).join(firsts, ["a_key", "p_key"], "left").drop("a_key", "p_key")


def with_cells(df: DataFrame, radius_m: float, max_lat: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Grid cell of each row; cells are at least radius_m wide up to latitude max_lat."""
    lat_step = degrees(radius_m / S.EARTH_M) * 1.0001
    lng_step = lat_step / max(0.01, cos(radians(max_lat)))
    return df.withColumn("cell_y", F.floor(F.col(lat) / lat_step)).withColumn("cell_x", F.floor(F.col(lng) / lng_step))


def radius_join(a: DataFrame, b: DataFrame, radius_m: float, max_lat: float = 72.0, keep_cells: bool = False) -> DataFrame:
    """All pairs of rows of ``a`` (id, lat, lng) and ``b`` (peer_id, peer_lat, peer_lng) within radius_m, with ``dist``.

    Rows meet by an equi-join on grid cells: those of ``a`` go to the nine cells around them. With ``keep_cells``
    the cell (cell_y, cell_x) of the row of ``b`` stays, by which the pairs are dealt.
    """
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), y -> transform(sequence(-1, 1), x -> struct(cell_y + y AS cell_y, cell_x + x AS cell_x))))"))
    left = with_cells(a.filter("lat is not null and lng is not null"), radius_m, max_lat).withColumn("cell", around)
    left = left.withColumn("cell_y", F.col("cell.cell_y")).withColumn("cell_x", F.col("cell.cell_x")).drop("cell")
    right = with_cells(b.filter("peer_lat is not null and peer_lng is not null"), radius_m, max_lat, "peer_lat", "peer_lng")
    pairs = left.join(right, ["cell_y", "cell_x"]).withColumn("dist", S.haversine("lat", "lng", "peer_lat", "peer_lng"))
    pairs = pairs.filter(F.col("dist") <= radius_m)
    return pairs if keep_cells else pairs.drop("cell_y", "cell_x")


def first_two(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The rows of the first two values of ``order`` in each key, repeats once."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place_", place).filter("place_ <= 2").distinct()


def nearest_ranked(a: DataFrame, b: DataFrame, radius_m: float, exclude_self: bool = True) -> DataFrame:
    """(id, donor_id, dist, rank): the nearest row of ``b`` (peer_id, peer_lat, peer_lng, rank); of equal distances the lowest rank.

    Rows at one place have the same neighbours, so places meet places, however many
    rows share one. Each keeps its two nearest: the second is for the nearest row itself.
    """
    at = ["lat", "lng"]
    cand = first_two(b.filter("peer_lat is not null and peer_lng is not null").select("peer_id", "peer_lat", "peer_lng", "rank"), ["peer_lat", "peer_lng"], "rank", "peer_id").drop("place_")
    rows = a.filter("lat is not null and lng is not null").select("id", *at)
    met = radius_join(rows.select(*at).distinct(), cand, radius_m).select(*at, "dist", "rank", "peer_id")
    best = first_two(met, at, "dist", "rank", "peer_id").groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("dist", "rank", "peer_id"))).alias("best"))
    found = F.get(F.filter("best", lambda x: x["peer_id"] != F.col("id")) if exclude_self else F.col("best"), F.lit(0))
    chosen = rows.join(best, at).select("id", found.alias("x")).filter("x is not null").groupBy("id").agg(F.min("x").alias("x"))
    return chosen.select("id", F.col("x.peer_id").alias("donor_id"), F.col("x.dist").alias("dist"), F.col("x.rank").alias("rank"))


def nearest_within(a: DataFrame, b: DataFrame, radius_m: float, exclude_self: bool = True) -> DataFrame:
    """(id, donor_id, dist) of ``nearest_ranked``."""
    return nearest_ranked(a, b, radius_m, exclude_self).drop("rank")


def nearest_or_none(a: DataFrame, b: DataFrame, radius_m: float) -> DataFrame:
    """The nearest of all; none if that is the row itself."""
    return nearest_within(a, b, radius_m, exclude_self=False).filter("id != donor_id")


def count_pairs(rows: DataFrame, radius_m: float) -> DataFrame:
    """(pairs, rows): how many pairs of rows (id, lat, lng) of different ids lie within radius_m, and how many ids are in one.

    Counted by place, so rows that share a place are never paired one by one. Rows of one id share a place.
    """
    per_id = rows.filter("id is not null and lat is not null and lng is not null").groupBy("id", "lat", "lng").agg(F.count("*").alias("c"))
    places = per_id.groupBy("lat", "lng").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"), F.count("*").alias("ids"))
    peers = places.select(F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng"), F.col("n").alias("peer_n"))
    seen = radius_join(places, peers, radius_m).groupBy("lat", "lng", "n", "own", "ids").agg(F.sum("peer_n").alias("seen"))
    in_one = F.when((F.col("seen") > F.col("n")) | (F.col("ids") > 1), F.col("ids")).otherwise(0)
    return seen.agg(F.coalesce(F.sum(F.col("n") * F.col("seen") - F.col("own")), F.lit(0)).alias("pairs"), F.coalesce(F.sum(in_one), F.lit(0)).alias("rows"))


def donor_candidates(rows: DataFrame, columns: tuple[str, ...] = ("brj", "mvv")) -> DataFrame:
    """Rows that may give their values: coordinates, no pointer, all values valid."""
    ok = F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.coalesce(F.trim("donor"), F.lit("")) == "")
    for c in columns:
        ok = ok & S.valid_minutes(c)
    return rows.filter(ok)


def donor_distance(geo: DataFrame) -> DataFrame:
    """(id, metres): how far each row (id, lat, lng, donor) is from its direct donor, where both have a place.

    Blank pointers stay out of the join: they would all meet in one task.
    """
    placed = geo.filter("lat is not null")
    pointed = placed.select("id", "lat", "lng", F.trim("donor").alias("donor_id")).filter("donor_id <> ''")
    donors = placed.select(F.col("id").alias("donor_id"), F.col("lat").alias("d_lat"), F.col("lng").alias("d_lng"))
    return pointed.join(donors, "donor_id").select("id", S.half_up(S.haversine("lat", "lng", "d_lat", "d_lng")).alias("metres"))


def chain_roots(links: DataFrame) -> DataFrame:
    """(id, root) for links (id, target), one per id: the end of each chain; a cycle, and what leads into it, roots in its smallest member.

    Pointers are doubled, each with the smallest id met on its way. A row that
    meets itself as the smallest is its cycle's smallest member, and in the same
    round all of the cycle have met it. A pointer to a row whose root is known
    takes that root. So the rounds follow the longest way, not the number of links.
    """
    from listaro.staging import drop_stage, stage

    met_self = F.col("low").eqNullSafe(F.col("id"))
    first = links.select("id", F.col("target").alias("at"), F.col("target").alias("low"), F.lit(True).alias("open"), F.lit(False).alias("smallest"))
    current = stage(first.withColumns({"smallest": met_self, "open": ~met_self}), "chain")
    while True:
        ahead = current.select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("low").alias("low_beyond"), F.col("open").alias("open_beyond"))
        met = current.filter("open").select("id", "at", "low").join(ahead, "at", "left")
        on = F.coalesce("open_beyond", F.lit(False))
        moved = met.select("id", F.coalesce("beyond", "at").alias("at"), F.when(on, F.least("low", "low_beyond")).otherwise(F.col("low")).alias("low"), on.alias("open"))
        smallest = F.col("open") & met_self
        moved = moved.withColumn("smallest", smallest).withColumns({"at": F.when(F.col("smallest"), F.col("id")).otherwise(F.col("at")), "open": F.col("open") & ~F.col("smallest")})
        stepped = stage(moved.unionByName(current.filter("not open").withColumn("smallest", F.lit(False))), "chain")
        drop_stage(current)
        current = stepped
        left = current.agg(F.coalesce(F.count_if("open"), F.lit(0)).alias("open"), F.coalesce(F.count_if("smallest"), F.lit(0)).alias("smallest")).first()
        if left["smallest"]:
            lows = current.filter("smallest").select(F.col("id").alias("low"), F.lit(True).alias("found"))
            known = current.filter("open").join(lows, "low", "left")
            known = known.withColumns({"at": F.when(F.col("found"), F.col("low")).otherwise(F.col("at")), "open": F.col("found").isNull()}).drop("found")
            stepped = stage(known.select(*current.columns).unionByName(current.filter("not open")), "chain")
            drop_stage(current)
            current = stepped
        if not left["open"]:
            return current.select("id", F.col("at").alias("root"))


def chain_value(nodes: DataFrame) -> DataFrame:
    """(id, value) for nodes (id, target, value): the first value that is not null on the way from a node along its pointers, itself included.

    Failure codes are values. A cycle without a value, like a chain's end, gives null.
    """
    from listaro.staging import drop_stage, stage

    current, steps = stage(nodes.select("id", F.col("target").alias("at"), "value"), "chain-values"), 1
    nodes_in_all = current.count()
    while True:
        if steps > nodes_in_all or current.filter("value is null and at is not null").isEmpty():
            return current.select("id", "value")
        ahead = current.select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("value").alias("next_value"))
        stepped = stage(current.join(ahead, "at", "left").select("id", F.col("beyond").alias("at"), F.coalesce("value", "next_value").alias("value")), "chain-values")
        drop_stage(current)
        current, steps = stepped, steps * 2


def one_per_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """One of the rows (with an id) of each root of (id, root): the root itself if it is among them, else the smallest id; rows without a root are their own."""
    keyed = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return first_per_key(keyed, ["root"], (F.col("id") != F.col("root")).cast("int"), "id")


def first_pool(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both candidate pools by id; of an id in both, the row of the first."""
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"))


def nearest_covering(listings: DataFrame, stations: DataFrame, default_m: float = 1000.0) -> DataFrame:
    """(id, station_id, dist): the nearest station whose own radius covers the listing; of equal distances the smallest id.

    Stations meet the listings' places on a grid that fits their reach: one per doubling of it, however large.
    Of stations with one place and reach the smallest id stands for all.
    """
    at = ["lat", "lng"]
    peers = stations.select(F.col("station_id").alias("peer_id"), F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng"), F.coalesce(F.col("radius_m").cast("double"), F.lit(default_m)).alias("reach"))
    peers = peers.groupBy("peer_lat", "peer_lng", "reach").agg(F.min("peer_id").alias("peer_id"))
    size = F.ceil(F.log2(F.greatest("reach", F.lit(1.0)))).cast("int")
    # As many as there are doublings between the smallest and the largest reach.
    sizes = sorted(r["size"] for r in peers.filter("reach is not null").select(size.alias("size")).distinct().collect())
    rows, pairs = listings.filter("lat is not null and lng is not null").select("id", *at), None
    for s in sizes or [0]:
        found = radius_join(rows.select(*at).distinct(), peers.filter(size == s), float(2**s)).filter("dist <= reach").select(*at, "dist", "peer_id")
        pairs = found if pairs is None else pairs.unionByName(found)
    best = pairs.groupBy(*at).agg(F.min(F.struct("dist", "peer_id")).alias("x"))
    found = rows.join(best, at).groupBy("id").agg(F.min("x").alias("x"))
    return found.select("id", F.col("x.peer_id").alias("station_id"), F.col("x.dist").alias("dist"))


def mark_absent(listings: DataFrame, ids: DataFrame) -> DataFrame:
    """``listings`` with active off where the id is not among today's."""
    seen = ids.select("id").distinct().withColumn("seen_", F.lit(True))
    return listings.join(seen, "id", "left").withColumn("active", F.col("active") & F.coalesce("seen_", F.lit(False))).drop("seen_")


def mark_absent_url(b: DataFrame, urls: DataFrame) -> DataFrame:
    """The same by canonical URL; a null URL is never switched off."""
    seen = urls.select(S.canonical_url("url").alias("u_")).distinct().withColumn("seen_", F.lit(True))
    joined = b.withColumn("u_", S.canonical_url("url")).join(seen, "u_", "left")
    return joined.withColumn("active", F.when(F.col("url").isNotNull() & F.col("seen_").isNull() & F.col("active"), False).otherwise(F.col("active"))).drop("u_", "seen_")


def with_children(listings: DataFrame, facilities: DataFrame, findings: DataFrame) -> DataFrame:
    """Facilities in alphabetical order, findings by cost (unknown last) and grade."""
    fac = facilities.distinct().groupBy("id").agg(F.array_sort(F.collect_list("facility")).alias("facilities"))
    order = F.struct(F.coalesce(-F.col("kostnad_hoy"), F.lit(2**62)).alias("o1"), (-F.col("tg")).alias("o2"), "pos", "bygningsdel", "tg", "kostnad_hoy")
    fin = findings.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["bygningsdel"].alias("bygningsdel"), x["tg"].alias("tg"), x["kostnad_hoy"].alias("kostnad_hoy"))).alias("findings"))
    return listings.join(fac, "id", "left").join(fin, "id", "left")


def split_cached(inputs: DataFrame, cache: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of texts by content hash and version; misses once per hash."""
    keyed = inputs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    current = cache.filter(F.col("version") == version).select("sha")
    return keyed.join(current, "sha", "left_semi"), first_per_key(keyed.join(current, "sha", "left_anti"), ["sha"], "doc_id")


def neighbour_sales(sales: DataFrame, listings: DataFrame, most: int = 15) -> DataFrame:
    """The newest sales around each tracked anchor, with price per square metre."""
    tracked = sales.filter("near_id is not null and sold_price is not null").join(listings.select(F.col("id").alias("near_id")), "near_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("near_id").orderBy(F.col("sold_at").desc(), "id"))
    return tracked.withColumn("place", place).filter(F.col("place") <= most).withColumn("per_m2", S.price_per_m2("sold_price", "size"))
