"""Queries of the read path: scalars, visibility, selection, sorting, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.config import CONFIG
from listaro.functions import scalars as S
from listaro.operators import filters as O
from listaro.operators import joins as J
from listaro.plans.bindings import AS_OF_SQL, as_of, bound, cte

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
CAP, AREA = CONFIG.max_price, CONFIG.min_area


@query(cte("listings", "geo") + f"""
SELECT l.id, pris, bra_i,
  CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.brj IS NOT NULL THEN s.brj ELSE g.brj END AS brj,
  CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.mvv IS NOT NULL THEN s.mvv ELSE g.mvv END AS mvv,
  CASE WHEN coalesce(bra_primary, bra_i, bra_total) > 0 THEN cast(round_even(pris::DOUBLE / coalesce(bra_primary, bra_i, bra_total)::DOUBLE, 0) AS BIGINT) END AS pris_kvm
FROM listings l LEFT JOIN geo g USING (id) LEFT JOIN geo s ON s.id = g.donor
WHERE active AND {STATUS} NOT IN ('solgt', 'inaktiv') AND pris <= {CAP} AND bra_i >= {AREA}
""")
def visible_active(spark, d) -> DataFrame:
    """Active, in-budget listings with donor-resolved commutes, cheapest per square metre first, unknown last."""
    rows = O.visible_active(bound(spark, d, "listings")).join(J.resolve_donor(bound(spark, d, "geo")).select("id", "brj", "mvv"), "id", "left")
    return rows.select("id", "pris", "bra_i", "brj", "mvv", S.price_per_m2("pris", "bra_primary", "bra_i", "bra_total").alias("pris_kvm")).orderBy(F.col("pris_kvm").asc_nulls_last(), "id")


@query(cte("listings", "sold") + f"""
SELECT l.id, pris,
  CASE WHEN active THEN NULL WHEN {STATUS} = 'solgt' THEN 'Solgt' WHEN {STATUS} <> 'inaktiv' THEN NULL WHEN sold_price IS NOT NULL THEN 'Solgt'
       WHEN (epoch_us({AS_OF_SQL}) - epoch_us(updated_at)) / 86400000000.0 < 180 THEN 'Inaktiv' ELSE 'Trukket' END AS shown_status,
  sold_price + coalesce(collective_debt, 0) AS sold_total,
  cast(floor(CASE WHEN price_suggestion > 0 THEN (sold_price - price_suggestion) / price_suggestion::DOUBLE * 100.0 END * 10 + 0.5) AS BIGINT) AS premium_tenths
FROM listings l LEFT JOIN sold USING (id)
WHERE NOT active AND {STATUS} IN ('solgt', 'inaktiv') AND coalesce(pris, 0) <= {CAP} AND bra_i >= {AREA}
""")
def visible_closed(spark, d) -> DataFrame:
    rows = O.visible_closed(bound(spark, d, "listings")).join(bound(spark, d, "sold"), "id", "left")
    return rows.select(
        "id", "pris", S.closed_status("active", "status", "sold_price", "updated_at", as_of()).alias("shown_status"), S.sold_total("sold_price", "collective_debt").alias("sold_total"),
        S.half_up(S.premium_pct("sold_price", "price_suggestion") * 10).alias("premium_tenths"),
    )


@query(cte("listings_b") + f"""
SELECT b_id, 'b:' || substr(sha1(coalesce(url, '')), 1, 16) AS hash_id, pris, boligtype, rtrim(lower(trim(url)), '/') AS url_key, '' AS note
FROM listings_b WHERE active AND coalesce(pris, 0) <= {CAP} AND coalesce(trim(duplicate_of), '') = ''
""")
def visible_source_b(spark, d) -> DataFrame:
    return O.visible_source_b(bound(spark, d, "listings_b")).select("b_id", S.hash_id("url").alias("hash_id"), "pris", "boligtype", S.canonical_url("url").alias("url_key"), F.lit("").alias("note"))


@query(cte("listings") + f"SELECT id FROM listings WHERE active AND pris <= {CAP} AND bra_i >= {AREA}")
def tracked_ids(spark, d) -> DataFrame:
    return O.tracked_ids(bound(spark, d, "listings"))


@query(cte("listings") + f"""
SELECT 'all' AS mode, id FROM listings
UNION ALL SELECT 'inactive', id FROM listings WHERE NOT active AND coalesce(pris, 0) <= {CAP} AND bra_i >= {AREA}
UNION ALL SELECT 'open', id FROM listings WHERE NOT active AND coalesce(pris, 0) <= {CAP} AND bra_i >= {AREA} AND {STATUS} NOT IN ('solgt', 'inaktiv')
""")
def refresh_candidates(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings")
    parts = [O.refresh_candidates(rows, m).select(F.lit(m).alias("mode"), "id") for m in ("all", "inactive", "open")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(cte("listings") + r"SELECT count(*) AS n, count(*) FILTER (regexp_matches(lower(trim(url)), '/(newbuildings|lettings|projects)/')) AS excluded FROM listings")
def drop_excluded(spark, d) -> DataFrame:
    return bound(spark, d, "listings").agg(F.count("*").alias("n"), F.count_if(O.is_excluded()).alias("excluded"))


@query(cte("listings", "geo") + "SELECT l.id, active FROM listings l LEFT JOIN geo g USING (id) WHERE (lat IS NULL OR lng IS NULL) AND coalesce(geocode_failed, 0) = 0")
def missing_coordinates(spark, d) -> DataFrame:
    return O.missing_coordinates(bound(spark, d, "listings"), bound(spark, d, "geo"), include_inactive=True).select("id", "active")


def _poly_sql(lng: str, lat: str) -> str:
    p = CONFIG.polygon
    edges = list(zip(p, [p[-1], *p[:-1]]))
    hits = [f"(CASE WHEN (({y1}::DOUBLE > {lat}) <> ({y2}::DOUBLE > {lat})) AND ({lng} < ({x2 - x1!r}::DOUBLE) * ({lat} - {y1!r}::DOUBLE) / ({y2 - y1!r}::DOUBLE) + {x1!r}::DOUBLE) THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in edges]
    return "(" + " + ".join(hits) + ") % 2 = 1"


@query(cte("geo", "listings_b") + f"""
SELECT 'a' AS source, id, {_poly_sql('lng', 'lat')} AS inside FROM geo WHERE lat IS NOT NULL AND lng IS NOT NULL
UNION ALL SELECT 'b', b_id, {_poly_sql('lng', 'lat')} FROM listings_b WHERE lat IS NOT NULL AND lng IS NOT NULL
""")
def polygon_report(spark, d) -> DataFrame:
    """Every row with known coordinates and whether the area of interest holds it."""
    a = bound(spark, d, "geo").select(F.lit("a").alias("source"), "id", "lng", "lat")
    b = bound(spark, d, "listings_b").select(F.lit("b").alias("source"), F.col("b_id").alias("id"), "lng", "lat")
    rows = a.unionByName(b).filter("lat is not null and lng is not null")
    return rows.select("source", "id", O.in_polygon(F.col("lng"), F.col("lat")).alias("inside"))


@query(cte("geo") + "SELECT id FROM geo WHERE lng BETWEEN 10.2::DOUBLE AND 10.9::DOUBLE AND lat BETWEEN 59.7::DOUBLE AND 60.0::DOUBLE")
def in_bbox(spark, d) -> DataFrame:
    return bound(spark, d, "geo").filter(O.in_bbox(F.col("lng"), F.col("lat"), 10.2, 59.7, 10.9, 60.0)).select("id")


FILTERS = O.Filters(
    at_most={"pris": 6_000_000, "totalpris": 6_500_000, "felleskost_mnd": 5000, "maanedskost": 6200, "pris_kvm": 90_000},
    at_least={"bra_i": 45, "soverom": 1, "byggeaar": 1930},
    travel_max={"brj": 90, "mvv": 95},
    selected={"boligtype": ("", "1-URGENT", "2-HIGH", "5-LOW"), "energimerke": ("", "A")},
    selected_sets={"eieform": ("Eier",)},
    facilities=("Balkong",),
    sold_at_most={"sold_price": 5_500_000},
)


def _listing_items(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings").join(bound(spark, d, "geo").select("id", "brj", "mvv"), "id", "left").join(bound(spark, d, "sold").select("id", "sold_price"), "id", "left")
    fac = bound(spark, d, "facilities").groupBy("id").agg(F.collect_set("facility").alias("facilities"))
    rows = rows.join(fac, "id", "left")
    return rows.withColumns({"maanedskost": S.monthly_cost("felleskost_mnd", "kommunale_avg_aar"), "pris_kvm": S.price_per_m2("pris", "bra_primary", "bra_i", "bra_total"), "sold": ~F.col("active") & (S.status_key("status") == "solgt")})


def _filter_sql(unknown: str) -> str:
    f = FILTERS
    tests = [f"CASE WHEN {c} IS NULL THEN {unknown} ELSE {c} > {v} END" for c, v in f.at_most.items()]
    tests += [f"CASE WHEN {c} IS NULL THEN {unknown} ELSE {c} < {v} END" for c, v in f.at_least.items()]
    tests += [f"coalesce(CASE WHEN {c} < 0 THEN 999 ELSE {c} END > {v}, false)" for c, v in f.travel_max.items()]
    tests += [f"coalesce({c}, '') NOT IN ({', '.join(repr(x) for x in v)})" for c, v in f.selected.items()]
    tests += [f"CASE WHEN coalesce({c}, '') = '' THEN {unknown} ELSE {c} NOT IN ({', '.join(repr(x) for x in v)}) END" for c, v in f.selected_sets.items()]
    tests += [f"(sold AND CASE WHEN {c} IS NULL THEN {unknown} ELSE {c} > {v} END)" for c, v in f.sold_at_most.items()]
    tests += [f"CASE WHEN facilities IS NULL OR len(facilities) = 0 THEN {unknown} ELSE NOT list_contains(facilities, 'Balkong') END"]
    return " OR ".join(tests)


_ITEMS_SQL = cte("listings", "geo", "sold", "facilities") + f""", items AS (
SELECT l.*, g.brj, g.mvv, s.sold_price, f.facilities, NOT active AND {STATUS} = 'solgt' AS sold,
  cast(felleskost_mnd + coalesce(round_even(kommunale_avg_aar / 12, 0), 0) AS BIGINT) AS maanedskost,
  CASE WHEN coalesce(bra_primary, bra_i, bra_total) > 0 THEN cast(round_even(pris::DOUBLE / coalesce(bra_primary, bra_i, bra_total)::DOUBLE, 0) AS BIGINT) END AS pris_kvm
FROM listings l LEFT JOIN geo g USING (id) LEFT JOIN sold s USING (id)
LEFT JOIN (SELECT id, list(DISTINCT facility) AS facilities FROM facilities GROUP BY id) f USING (id))
"""


@query(_ITEMS_SQL + f"SELECT id, {_filter_sql('false')} AS excluded, {_filter_sql('true')} AS excluded_strict FROM items")
def listing_predicate(spark, d) -> DataFrame:
    """The shared selection with unknown values let through, and with them shut out."""
    from dataclasses import replace

    rows = _listing_items(spark, d)
    return rows.select("id", O.listing_excluded(FILTERS).alias("excluded"), O.listing_excluded(replace(FILTERS, include_unknown=False)).alias("excluded_strict"))


@query(_ITEMS_SQL + f"""
, flags AS (SELECT id, active AS in_universe, ({_filter_sql('false')}) AS excluded,
  coalesce(contains(lower(adresse), '12'), false) OR coalesce(contains(lower(postnummer), '12'), false) AS hit FROM items)
SELECT count(*) FILTER (in_universe) AS universe, count(*) FILTER ((in_universe AND NOT excluded AND hit) OR id = '8') AS shown FROM flags
""")
def partition_rows(spark, d) -> DataFrame:
    rows = O.partition_rows(_listing_items(spark, d), F.col("active"), O.listing_excluded(FILTERS), O.matches_text("12", "adresse", "postnummer"), focus="8")
    return rows.agg(F.count_if("in_universe").alias("universe"), F.count_if("shown").alias("shown"))


@query(cte("listings") + f"""
SELECT id, CASE WHEN active THEN 'active' WHEN {STATUS} = 'solgt' THEN 'sold' WHEN {STATUS} = 'inaktiv' THEN 'inactive' ELSE 'active' END AS bucket,
  coalesce((epoch_us({AS_OF_SQL}) - epoch_us(scraped_at)) / 86400000000.0 BETWEEN 0 AND 200, false) AS is_fresh FROM listings
""")
def bucket_and_freshness(spark, d) -> DataFrame:
    return bound(spark, d, "listings").select("id", O.bucket_of().alias("bucket"), O.fresh("scraped_at", as_of(), 200).alias("is_fresh"))


@query(cte("listings") + r"""
, k AS (SELECT id, adresse, postnummer, lower(trim(coalesce(adresse, ''))) AS a, regexp_replace(trim(coalesce(postnummer, '')), '\.0$', '') AS p FROM listings),
cut AS (SELECT id, adresse, trim(adresse) AS c0 FROM k),
cut1 AS (SELECT *, CASE WHEN contains(c0, ' - ') THEN trim(split_part(c0, ' - ', 1)) ELSE c0 END AS c1 FROM cut),
cut2 AS (SELECT *, CASE WHEN contains(c1, ' (') THEN trim(split_part(c1, ' (', 1)) ELSE c1 END AS c2 FROM cut1),
cut3 AS (SELECT *, CASE WHEN contains(c2, ' [') THEN trim(split_part(c2, ' [', 1)) ELSE c2 END AS c3 FROM cut2),
cut4 AS (SELECT *, CASE WHEN contains(c3, ' /') THEN trim(split_part(c3, ' /', 1)) ELSE c3 END AS c4 FROM cut3)
SELECT k.id, regexp_replace(regexp_replace(a, '[.,©()"''\\/]+', '', 'g'), '\s+', ' ', 'g') AS address_key,
  CASE WHEN regexp_full_match(p, '\d{1,3}') THEN lpad(p, 4, '0') ELSE p END AS postcode_key,
  c4 AS clean_address,
  coalesce('https://www.google.com/maps/place/' || replace(trim(k.adresse) || '+' || trim(postnummer), ' ', '+'), '') AS map_url
FROM k JOIN cut4 ON k.id = cut4.id
""")
def address_functions(spark, d) -> DataFrame:
    return bound(spark, d, "listings").select("id", S.address_key("adresse").alias("address_key"), S.postcode_key("postnummer").alias("postcode_key"), S.clean_address("adresse").alias("clean_address"), S.map_url("adresse", "postnummer").alias("map_url"))


@query(cte("listings") + r"""
, ch AS (SELECT id, adresse, unnest(range(1, length(adresse) + 1)) AS i FROM listings WHERE adresse <> '')
SELECT l.id, CASE WHEN l.adresse IS NULL OR l.adresse = '' THEN l.adresse ELSE t.title END AS title,
  CASE WHEN postnummer IS NULL THEN '' ELSE lpad(postnummer, cast(greatest(4, length(postnummer)) AS INTEGER), '0') END AS padded
FROM listings l LEFT JOIN (
  SELECT id, string_agg(CASE WHEN i = 1 OR NOT regexp_matches(adresse[i - 1], '\p{L}') THEN upper(adresse[i]) ELSE lower(adresse[i]) END, '' ORDER BY i) AS title FROM ch GROUP BY id
) t USING (id)
""")
def title_case(spark, d) -> DataFrame:
    return bound(spark, d, "listings").select("id", S.title_case("adresse").alias("title"), S.padded_postcode("postnummer").alias("padded"))


@query(cte("listings", "findings") + """
SELECT id, CASE WHEN totalpris > 0 AND bra_i > 0 THEN cast(round_even(totalpris / bra_i, 0) AS BIGINT) END AS total_kvm,
  cast(felleskost_mnd + coalesce(round_even(kommunale_avg_aar / 12, 0), 0) AS BIGINT) AS monthly,
  coalesce(pris, 0) AS pris_or_zero, coalesce(trim(image_url), '') AS image_cell
FROM listings
""")
def derived_costs(spark, d) -> DataFrame:
    return bound(spark, d, "listings").select("id", S.total_per_m2("totalpris", "bra_i").alias("total_kvm"), S.monthly_cost("felleskost_mnd", "kommunale_avg_aar").alias("monthly"), S.int_or_zero("pris").alias("pris_or_zero"), S.cell("image_url").alias("image_cell"))


@query(cte("geo") + """
SELECT id, CASE brj WHEN -1 THEN 'no route' WHEN -2 THEN 'unrealistic' WHEN -3 THEN 'api error' END AS label, coalesce(brj BETWEEN 1 AND 360, false) AS valid,
  CASE WHEN brj IS NULL THEN -1 WHEN brj * 61 // 60 < 1 OR brj * 61 // 60 > 360 THEN -2 ELSE brj * 61 // 60 END AS minutes
FROM (SELECT id, CASE WHEN brj >= 0 THEN brj END AS brj, brj AS raw FROM geo) WHERE raw IS NULL OR raw >= 0
UNION ALL SELECT id, CASE brj WHEN -1 THEN 'no route' WHEN -2 THEN 'unrealistic' END, false, -1 FROM geo WHERE brj < 0
""")
def travel_values(spark, d) -> DataFrame:
    text = F.when(F.col("brj") >= 0, F.concat((F.col("brj") * 61).cast("string"), F.lit("s")))
    return bound(spark, d, "geo").select("id", S.sentinel_label("brj").alias("label"), S.valid_minutes("brj").alias("valid"), S.duration_minutes(text).alias("minutes"))


@query(cte("geo") + """
, m AS (SELECT id, CASE WHEN cast(id AS BIGINT) % 5 = 0 THEN lng ELSE lat END AS a, CASE WHEN cast(id AS BIGINT) % 5 = 0 THEN lat WHEN cast(id AS BIGINT) % 5 = 1 THEN 99::DOUBLE ELSE lng END AS b FROM geo)
SELECT id, CASE WHEN a BETWEEN 57 AND 72 AND b BETWEEN 4 AND 32 THEN a WHEN b BETWEEN 57 AND 72 AND a BETWEEN 4 AND 32 THEN b END AS lat,
  CASE WHEN a BETWEEN 57 AND 72 AND b BETWEEN 4 AND 32 THEN b WHEN b BETWEEN 57 AND 72 AND a BETWEEN 4 AND 32 THEN a END AS lng,
  coalesce(NOT (a BETWEEN 57 AND 72 AND b BETWEEN 4 AND 32) AND (b BETWEEN 57 AND 72 AND a BETWEEN 4 AND 32), false) AS swapped FROM m
""")
def coordinates(spark, d) -> DataFrame:
    k = F.col("id").cast("long") % 5
    rows = bound(spark, d, "geo").select("id", F.when(k == 0, F.col("lng")).otherwise(F.col("lat")).alias("a"), F.when(k == 0, F.col("lat")).when(k == 1, 99.0).otherwise(F.col("lng")).alias("b"))
    return rows.select("id", S.normal_coordinates("a", "b").alias("c")).select("id", "c.lat", "c.lng", "c.swapped")


@query(cte("listings") + """
SELECT 'up' AS page, row_number() OVER (ORDER BY pris ASC NULLS LAST, id) AS place, id, pris FROM listings QUALIFY place <= 500
UNION ALL SELECT 'down', row_number() OVER (ORDER BY pris DESC NULLS LAST, id) AS place, id, pris FROM listings QUALIFY place <= 500
""")
def sort_listings(spark, d) -> DataFrame:
    """The first 500 rows of the table sorted by price either way, with their places; unknown prices are last in both."""
    from pyspark.sql import Window

    rows = bound(spark, d, "listings").select("id", "pris")
    pages = []
    for page, price in (("up", F.col("pris").asc_nulls_last()), ("down", F.col("pris").desc_nulls_last())):
        # A sorted page is a top-k: only its rows meet in one task.
        top = rows.orderBy(price, "id").limit(500)
        pages.append(top.select(F.lit(page).alias("page"), F.row_number().over(Window.orderBy(price, "id")).cast("long").alias("place"), "id", "pris"))
    return pages[0].unionAll(pages[1])


@query(cte("listings") + """
SELECT id FROM listings WHERE active AND coalesce(trim(image_url), '') <> '' AND cast(id AS BIGINT) % 3 <> 0
""")
def asset_candidates(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings")
    return O.asset_candidates(rows, rows.filter("cast(id as bigint) % 3 = 0").select("id")).select("id")


@query(cte("listings", "listings_b") + r"""
, a AS (SELECT regexp_replace(regexp_replace(lower(trim(coalesce(adresse, ''))), '[.,©()"''\\/]+', '', 'g'), '\s+', ' ', 'g') AS ak,
   CASE WHEN regexp_full_match(regexp_replace(trim(coalesce(postnummer, '')), '\.0$', ''), '\d{1,3}') THEN lpad(regexp_replace(trim(coalesce(postnummer, '')), '\.0$', ''), 4, '0') ELSE regexp_replace(trim(coalesce(postnummer, '')), '\.0$', '') END AS pk,
   id FROM listings),
f AS (SELECT ak, pk, arg_min(id, cast(id AS BIGINT)) AS match_id FROM a GROUP BY ak, pk)
SELECT b_id, match_id FROM (SELECT b_id, regexp_replace(regexp_replace(lower(trim(coalesce(adresse, ''))), '[.,©()"''\\/]+', '', 'g'), '\s+', ' ', 'g') AS ak,
   CASE WHEN regexp_full_match(regexp_replace(trim(coalesce(postnummer, '')), '\.0$', ''), '\d{1,3}') THEN lpad(regexp_replace(trim(coalesce(postnummer, '')), '\.0$', ''), 4, '0') ELSE regexp_replace(trim(coalesce(postnummer, '')), '\.0$', '') END AS pk FROM listings_b) LEFT JOIN f USING (ak, pk)
""")
def match_sources(spark, d) -> DataFrame:
    return J.match_sources(bound(spark, d, "listings_b"), bound(spark, d, "listings"), F.col("id").cast("long")).select("b_id", "match_id")


@query(cte("geo") + "SELECT count(*) AS pairs, count(DISTINCT a.id) AS rows FROM geo a JOIN geo b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.003 AND abs(a.lng - b.lng) < 0.006 AND 2 * 6371000.0 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)), sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 300")
def radius_join(spark, d) -> DataFrame:
    return J.count_pairs(bound(spark, d, "geo").select("id", "lat", "lng"), 300.0)


_DIST = "2 * 6371000.0 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)), sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


def _donor_sql(self_rule: str, final: str) -> str:
    return cte("geo") + f"""
, c AS (SELECT id, lat, lng, cast(id AS BIGINT) AS ord FROM geo WHERE lat IS NOT NULL AND lng IS NOT NULL AND coalesce(trim(donor), '') = '' AND brj BETWEEN 1 AND 360 AND mvv BETWEEN 1 AND 360),
p AS (SELECT a.id, b.id AS donor_id, {_DIST} AS dist, b.ord FROM geo a JOIN c b ON abs(a.lat - b.lat) < 0.003 AND abs(a.lng - b.lng) < 0.006 {self_rule}),
n AS (SELECT id, arg_min(donor_id, (dist, ord)) AS donor_id FROM p WHERE dist <= 300 GROUP BY id)
{final}"""


def _donor_pool(spark, d) -> DataFrame:
    pool = J.donor_candidates(bound(spark, d, "geo"))
    return pool.select(F.col("id").alias("peer_id"), F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng"), F.col("id").cast("long").alias("rank"))


@query(_donor_sql("AND a.id <> b.id", "SELECT id, donor_id FROM n"))
def nearest_donor(spark, d) -> DataFrame:
    return J.nearest_within(bound(spark, d, "geo").select("id", "lat", "lng"), _donor_pool(spark, d), 300.0).select("id", "donor_id")


@query(_donor_sql("", "SELECT id, donor_id FROM n WHERE id <> donor_id"))
def nearest_donor_or_none(spark, d) -> DataFrame:
    return J.nearest_or_none(bound(spark, d, "geo").select("id", "lat", "lng"), _donor_pool(spark, d), 300.0).select("id", "donor_id")


@query(_donor_sql("", "SELECT count(*) AS rows, count(*) FILTER (n.donor_id IS NULL OR n.donor_id = g.id) AS calls FROM geo g LEFT JOIN n USING (id)"))
def estimate_calls(spark, d) -> DataFrame:
    """How many rows would need a new value if every other reused its nearest donor's."""
    geo = bound(spark, d, "geo").select("id", "lat", "lng")
    found = J.nearest_or_none(geo, _donor_pool(spark, d), 300.0).select("id", "donor_id")
    return geo.join(found, "id", "left").agg(F.count("*").alias("rows"), F.count_if(F.col("donor_id").isNull()).alias("calls"))


@query(cte("listings", "facilities", "findings") + """
SELECT l.id, f.facilities, x.findings FROM listings l
LEFT JOIN (SELECT id, list(DISTINCT facility ORDER BY facility) AS facilities FROM facilities GROUP BY id) f USING (id)
LEFT JOIN (SELECT id, list({'bygningsdel': bygningsdel, 'tg': tg, 'kostnad_hoy': kostnad_hoy} ORDER BY kostnad_hoy DESC NULLS LAST, tg DESC, pos, bygningsdel) AS findings FROM findings GROUP BY id) x USING (id)
""")
def with_children(spark, d) -> DataFrame:
    return J.with_children(bound(spark, d, "listings").select("id"), bound(spark, d, "facilities"), bound(spark, d, "findings"))


@query(cte("sold", "listings") + """
SELECT near_id, id, place, per_m2 FROM (
  SELECT near_id, s.id, row_number() OVER (PARTITION BY near_id ORDER BY sold_at DESC, s.id) AS place,
    CASE WHEN size > 0 THEN cast(round_even(sold_price::DOUBLE / size::DOUBLE, 0) AS BIGINT) END AS per_m2
  FROM sold s WHERE near_id IS NOT NULL AND sold_price IS NOT NULL AND near_id IN (SELECT id FROM listings)) WHERE place <= 15
""")
def neighbour_sales(spark, d) -> DataFrame:
    return J.neighbour_sales(bound(spark, d, "sold"), bound(spark, d, "listings")).select("near_id", "id", "place", "per_m2")


@query(cte("listings") + "SELECT id, active AND cast(id AS BIGINT) % 3 <> 0 AS active FROM listings")
def mark_absent(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings").select("id", "active")
    return J.mark_absent(rows, rows.filter("cast(id as bigint) % 3 <> 0"))


@query(cte("listings_b") + "SELECT b_id, CASE WHEN url IS NOT NULL AND cast(b_id AS BIGINT) % 4 = 0 AND active THEN false ELSE active END AS active FROM listings_b")
def mark_absent_url(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings_b")
    return J.mark_absent_url(rows, rows.filter("cast(b_id as bigint) % 4 <> 0").select(F.upper("url").alias("url"))).select("b_id", "active")


@query("""
WITH t AS (SELECT doc_id, text, sha256(text) AS sha FROM documents),
c AS (SELECT DISTINCT sha FROM t WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)
SELECT 'hit' AS kind, doc_id FROM t WHERE sha IN (SELECT sha FROM c)
UNION ALL SELECT 'miss', min(doc_id) FROM t WHERE sha NOT IN (SELECT sha FROM c) GROUP BY sha
""")
def split_cached(spark, d) -> DataFrame:
    from listaro.staging import read_table

    docs = read_table(spark, f"{d}/documents.parquet").select("doc_id", "text")
    cache = docs.filter("doc_id % 3 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), (F.col("doc_id") % 2).alias("version")).distinct()
    hits, misses = J.split_cached(docs, cache, 0)
    return hits.select(F.lit("hit").alias("kind"), "doc_id").unionAll(misses.select(F.lit("miss").alias("kind"), "doc_id"))


@query(cte("geo", "stations") + f"""
, p AS (SELECT a.id, b.station_id, {_DIST} AS dist, coalesce(b.radius_m, 1000) AS reach FROM geo a JOIN stations b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lng - b.lng) < 0.04)
SELECT id, arg_min(station_id, (dist, station_id)) AS station_id FROM p WHERE dist <= reach GROUP BY id
""")
def nearest_station(spark, d) -> DataFrame:
    return J.nearest_covering(bound(spark, d, "geo"), bound(spark, d, "stations")).select("id", "station_id")
