"""Further queries: stations, second source, sidecar merges, progress counts, payloads, display texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import joins as J
from listaro.operators import merge as M
from listaro.operators import publish as B
from listaro.operators import ranking as R
from listaro.plans.bindings import AS_OF_SQL, as_of, bound, cte
from listaro.plans.documents import _LINES, _stations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STATUS = "lower(trim(coalesce(status, '')))"
_DIST = "2 * 6371000.0 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)), sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(cte("stations") + f""", {_LINES}
SELECT s.station_id FROM stations s JOIN (SELECT station_id FROM lines WHERE line IN ('L3', 'L7', 'L12') GROUP BY 1) l USING (station_id)
JOIN (SELECT station_id, least(min(minutes) FILTER (destination = 'brj'), min(minutes) FILTER (destination = 'mvvx')) AS m FROM travel GROUP BY 1) t USING (station_id) WHERE m <= 25
""")
def visible_stations(spark, d) -> DataFrame:
    """Stations with a chosen line whose better destination is within reach."""
    summary = B.station_summary(*_stations(spark, d))
    best = F.least(F.col("minutes")["brj"], F.col("minutes")["mvvx"])
    return summary.filter(F.arrays_overlap("lines", F.array(F.lit("L3"), F.lit("L7"), F.lit("L12"))) & (best <= 25)).select("station_id")


@query(cte("geo", "stations") + f"""
, p AS (SELECT a.id, b.station_id, {_DIST} AS dist, coalesce(b.radius_m, 1000) AS reach FROM geo a JOIN stations b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lng - b.lng) < 0.04),
n AS (SELECT id, arg_min(station_id, (dist, station_id)) AS station_id FROM p WHERE dist <= reach GROUP BY id)
SELECT g.id, CASE WHEN n.station_id IS NULL THEN true WHEN n.station_id % 6 = 0 THEN false ELSE 10 + n.station_id % 40 > 30 END AS excluded FROM geo g LEFT JOIN n USING (id) WHERE lat IS NOT NULL
""")
def commute_excluded(spark, d) -> DataFrame:
    """Listings outside every station's radius, or whose nearest station is too far from town; an unknown time excludes nothing."""
    geo = bound(spark, d, "geo").filter("lat is not null")
    near = J.nearest_covering(geo, bound(spark, d, "stations")).select("id", "station_id")
    minutes = F.when(F.col("station_id") % 6 != 0, 10 + F.col("station_id") % 40)
    return geo.select("id").join(near, "id", "left").select("id", F.when(F.col("station_id").isNull(), True).otherwise(F.coalesce(minutes > 30, F.lit(False))).alias("excluded"))


@query(cte("listings_b") + """
, inc AS (SELECT CASE WHEN cast(b_id AS BIGINT) % 5 = 0 THEN url || '?x' ELSE url END AS url, CASE WHEN cast(b_id AS BIGINT) % 10 = 0 THEN 'z' || b_id ELSE b_id END AS b_id, pris + 1 AS pris, CASE WHEN cast(b_id AS BIGINT) % 3 = 0 THEN 60.5::DOUBLE END AS lat FROM listings_b WHERE cast(b_id AS BIGINT) % 2 = 0),
m AS (SELECT i.*, coalesce(u.b_id, s.b_id) AS known FROM inc i LEFT JOIN listings_b u ON u.url = i.url LEFT JOIN listings_b s ON s.b_id = i.b_id)
SELECT coalesce(b.b_id, m.b_id) AS b_id, CASE WHEN m.b_id IS NOT NULL THEN m.pris ELSE b.pris END AS pris, coalesce(m.lat, b.lat) AS lat, CASE WHEN b.b_id IS NULL THEN NULL WHEN m.b_id IS NOT NULL THEN true ELSE b.active END AS active
FROM listings_b b FULL JOIN m ON m.known = b.b_id
""")
def upsert_source_b(spark, d) -> DataFrame:
    """Rows of the second source matched by address first, else by id: prices are set, coordinates filled, activity null at first sight."""
    base = bound(spark, d, "listings_b").select("b_id", "url", "pris", "lat", "active")
    k = F.col("b_id").cast("long")
    inc = base.filter(k % 2 == 0).select(F.when(k % 5 == 0, F.concat("url", F.lit("?x"))).otherwise(F.col("url")).alias("url"), F.when(k % 10 == 0, F.concat(F.lit("z"), "b_id")).otherwise(F.col("b_id")).alias("i_id"), (F.col("pris") + 1).alias("i_pris"), F.when(k % 3 == 0, 60.5).alias("i_lat"))
    by_url = base.select("url", F.col("b_id").alias("u_id"))
    by_id = base.select(F.col("b_id").alias("s_id"))
    matched = inc.join(by_url, "url", "left").join(by_id, F.col("i_id") == F.col("s_id"), "left").select("i_id", "i_pris", "i_lat", F.coalesce("u_id", "s_id").alias("known"))
    both = base.join(matched, F.col("b_id") == F.col("known"), "full")
    return both.select(F.coalesce("b_id", "i_id").alias("b_id"), F.when(F.col("i_id").isNotNull(), F.col("i_pris")).otherwise(F.col("pris")).alias("pris"), F.coalesce("i_lat", "lat").alias("lat"), F.when(F.col("b_id").isNull(), None).when(F.col("i_id").isNotNull(), True).otherwise(F.col("active")).alias("active"))


_GEO_RULES = {"lat": "fill", "lng": "fill", "brj": "fill", "donor": "set", "geocode_failed": "set"}


@query(cte("geo") + """
, i AS (SELECT id, CASE WHEN cast(id AS BIGINT) % 4 = 0 THEN lat + 1 END AS lat, NULL::DOUBLE AS lng, CASE WHEN cast(id AS BIGINT) % 8 = 0 THEN 33 END AS brj, CASE WHEN cast(id AS BIGINT) % 16 = 0 THEN 'd' END AS donor, 0 AS geocode_failed FROM geo WHERE cast(id AS BIGINT) % 2 = 0)
SELECT g.id, coalesce(i.lat, g.lat) AS lat, coalesce(i.lng, g.lng) AS lng, coalesce(i.brj, g.brj) AS brj, CASE WHEN i.id IS NOT NULL THEN i.donor ELSE g.donor END AS donor, CASE WHEN i.id IS NOT NULL THEN i.geocode_failed ELSE g.geocode_failed END AS geocode_failed FROM geo g LEFT JOIN i USING (id)
""")
def upsert_geo(spark, d) -> DataFrame:
    base = bound(spark, d, "geo")
    k = F.col("id").cast("long")
    inc = base.filter(k % 2 == 0).select("id", F.when(k % 4 == 0, F.col("lat") + 1).alias("lat"), F.lit(None).cast("double").alias("lng"), F.when(k % 8 == 0, 33).alias("brj"), F.when(k % 16 == 0, "d").alias("donor"), F.lit(0).alias("geocode_failed"))
    return M.merge_by_rules(base, inc, _GEO_RULES)


@query(cte("geo") + f"""
SELECT a.id, cast(floor({_DIST} + 0.5) AS BIGINT) AS metres FROM geo a JOIN geo b ON b.id = trim(a.donor) WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL
""")
def donor_distance(spark, d) -> DataFrame:
    """How far each row is from its direct donor."""
    return J.donor_distance(bound(spark, d, "geo"))


@query(cte("listings", "geo", "sold", "attempts") + f"""
SELECT count(*) FILTER ({STATUS} = 'inaktiv' AND updated_at >= {AS_OF_SQL} - INTERVAL 180 DAY) AS grace, count(sold_price) FILTER ({STATUS} = 'inaktiv' AND updated_at >= {AS_OF_SQL} - INTERVAL 180 DAY) AS grace_priced,
  count(*) FILTER (sold_price IS NULL AND coalesce(attempts, 0) >= 5) AS given_up FROM listings l JOIN geo g USING (id) LEFT JOIN sold s USING (id) LEFT JOIN attempts a USING (id) WHERE lat IS NOT NULL AND {STATUS} IN ('solgt', 'inaktiv')
""")
def sale_progress(spark, d) -> DataFrame:
    """Closed listings in the grace period, those of them with a price, and those given up."""
    rows = bound(spark, d, "listings").join(bound(spark, d, "geo").filter("lat is not null").select("id"), "id").join(bound(spark, d, "sold").select("id", "sold_price"), "id", "left").join(bound(spark, d, "attempts"), "id", "left")
    s = S.status_key("status")
    grace = (s == "inaktiv") & (F.col("updated_at").cast("timestamp") >= as_of() - F.expr("INTERVAL 180 DAY"))
    rows = rows.filter(s.isin("solgt", "inaktiv"))
    return rows.agg(F.count_if(grace).alias("grace"), F.count_if(grace & F.col("sold_price").isNotNull()).alias("grace_priced"), F.count_if(F.col("sold_price").isNull() & (F.coalesce("attempts", F.lit(0)) >= 5)).alias("given_up"))


@query(cte("listings", "geo", "facilities") + """
SELECT l.id, pris, g.brj, g.mvv, f.facilities FROM listings l LEFT JOIN geo g USING (id) LEFT JOIN (SELECT id, list(DISTINCT facility ORDER BY facility) AS facilities FROM facilities GROUP BY id) f USING (id)
""")
def listing_payload(spark, d) -> DataFrame:
    """The nested payload, read back from its travel map."""
    rows = bound(spark, d, "listings").select("id", "pris").join(bound(spark, d, "geo").select("id", "brj", "mvv"), "id", "left")
    fac = bound(spark, d, "facilities").distinct().groupBy("id").agg(F.array_sort(F.collect_list("facility")).alias("facilities"))
    nested = B.payload(rows.join(fac, "id", "left"))
    return nested.select("id", "pris", F.col("travel")["brj"].alias("brj"), F.col("travel")["mvv"].alias("mvv"), "facilities")


@query(cte("listings", "geo") + f"""
, r AS (SELECT l.*, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.brj IS NOT NULL THEN s.brj ELSE g.brj END AS brj, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.mvv IS NOT NULL THEN s.mvv ELSE g.mvv END AS mvv, coalesce(bra_total, bra_primary, bra_i) AS area
 FROM listings l LEFT JOIN geo g USING (id) LEFT JOIN geo s ON s.id = g.donor),
o AS (SELECT id, CASE WHEN {STATUS} = 'solgt' THEN 2 WHEN active AND {STATUS} NOT IN ('solgt', 'inaktiv') THEN 0 ELSE 1 END AS tier,
  CASE WHEN coalesce(area < 80 OR brj > 70 OR mvv > 70, false) THEN 2 WHEN coalesce(area >= 80 AND brj BETWEEN 0 AND 70 AND mvv BETWEEN 0 AND 70, false) THEN 0 ELSE 1 END AS band FROM r)
SELECT id, 'hit' AS kind FROM o WHERE cast(id AS BIGINT) % 5 = 0
UNION ALL SELECT id, 'paid' FROM (SELECT id FROM o WHERE cast(id AS BIGINT) % 5 <> 0 ORDER BY tier, band, cast(id AS BIGINT) LIMIT 200)
""")
def select_work(spark, d) -> DataFrame:
    order = R.classification_order(bound(spark, d, "listings"), bound(spark, d, "geo"))
    return R.select_work(order, order.filter("cast(id as bigint) % 5 = 0").select("id"), 200)


@query(cte("sold", "listings") + "SELECT id, sold_price FROM sold WHERE id IN (SELECT id FROM listings WHERE bra_i >= 100)")
def restrict_to_tracked(spark, d) -> DataFrame:
    return bound(spark, d, "sold").join(bound(spark, d, "listings").filter("bra_i >= 100").select("id"), "id", "left_semi").select("id", "sold_price")


@query(cte("findings") + """
SELECT id, pos, CASE WHEN kostnad_lav IS NULL THEN 'ukjent' ELSE cast(kostnad_lav // 1000 AS VARCHAR) || '-' || cast(kostnad_hoy // 1000 AS VARCHAR) || ' k' END AS band,
  CASE WHEN kostnad_lav >= 100000 THEN 100000 WHEN kostnad_lav >= 50000 THEN 50000 WHEN kostnad_lav >= 25000 THEN 25000 WHEN kostnad_lav >= 10000 THEN 10000 ELSE 0 END::BIGINT AS snapped FROM findings
""")
def cost_texts(spark, d) -> DataFrame:
    """Cost bands as text, and the low bound snapped down to the grid."""
    grid = F.array(*[F.lit(x) for x in (0, 10000, 25000, 50000, 100000)])
    k = F.lit(1000)
    band = F.when(F.col("kostnad_lav").isNull(), "ukjent").otherwise(F.concat(F.floor(F.col("kostnad_lav") / k).cast("string"), F.lit("-"), F.floor(F.col("kostnad_hoy") / k).cast("string"), F.lit(" k")))
    return bound(spark, d, "findings").select("id", "pos", band.alias("band"), F.array_max(F.filter(grid, lambda x: x <= F.coalesce("kostnad_lav", F.lit(0)))).cast("long").alias("snapped"))


@query(cte("observations") + "SELECT id, arg_max(event_id, (observed_at, event_id)) AS event_id FROM observations GROUP BY id")
def first_per_key(spark, d) -> DataFrame:
    """The newest observation of each id."""
    return J.first_per_key(bound(spark, d, "observations"), ["id"], F.col("observed_at").desc(), F.col("event_id").desc()).select("id", "event_id")


@query(cte("listings_b") + """
, h AS (SELECT b_id, 'b:' || substr(sha1(coalesce(url, '')), 1, 16) AS hash_id, active FROM listings_b)
SELECT h.hash_id, h.b_id, h.active FROM h JOIN (SELECT hash_id FROM h WHERE cast(b_id AS BIGINT) % 9 = 0) w USING (hash_id)
""")
def join_by_hash_id(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings_b").select("b_id", S.hash_id("url").alias("hash_id"), "active")
    return rows.join(rows.filter("cast(b_id as bigint) % 9 = 0").select("hash_id"), "hash_id").select("hash_id", "b_id", "active")


@query(cte("observations") + f"""
, o AS (SELECT event_id, CASE WHEN status = 'click' AND observed_at < TIMESTAMP '2024-01-15' THEN 'klikk' ELSE status END AS status FROM observations) SELECT coalesce(status, '-') AS status, count(*) AS n FROM o GROUP BY 1
""")
def relabel(spark, d) -> DataFrame:
    """Labels changed up to a date, counted."""
    rows = bound(spark, d, "observations")
    until = F.unix_micros(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    changed = M.relabel(rows.withColumn("stamp", F.unix_micros(F.col("observed_at").cast("timestamp"))), "status", "click", "klikk", until, "stamp")
    return changed.groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.count("*").alias("n"))
