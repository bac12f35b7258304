"""Queries over landed pages and prose, donor assignment, publishing and the batch side of streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import aggregates as A
from listaro.operators import donors as D
from listaro.operators import filters as O
from listaro.operators import joins as J
from listaro.operators import prose as P
from listaro.operators import publish as B
from listaro.plans.bindings import bound, cte
from listaro.sources import pages as L
from listaro.staging import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark, d) -> DataFrame:
    return read_table(spark, f"{d}/pages.parquet")


def _docs(spark, d) -> DataFrame:
    return read_table(spark, f"{d}/documents.parquet").select("doc_id", "text")


@query(r"""
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '') AS heading,
  nullif(trim(regexp_extract(html, '(?is)<html[^>]*\blang="([^"]*)"', 1)), '') AS lang, len(regexp_extract_all(html, '(?i)<a\s'))::BIGINT AS n_links,
  nullif(regexp_extract(url, '(\d+)[^\d]*$', 1), '') AS uid, sha256(html) AS sha FROM pages
""")
def page_fields(spark, d) -> DataFrame:
    return P.page_fields(_pages(spark, d))


@query("SELECT page_id, sha256(html) AS sha FROM pages WHERE page_id % 3 <> 0 OR page_id % 2 = 0")
def append_changed(spark, d) -> DataFrame:
    """Pages against a stored state in which every sixth page from the third on is up to date."""
    pages = _pages(spark, d).select(F.col("page_id").alias("id"), "html")
    stored = pages.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 1, F.sha2(F.col("html").cast("binary"), 256)).otherwise("old").alias("sha"))
    return L.append_changed(pages, stored).select(F.col("id").alias("page_id"), "sha")


@query(r"""
WITH a AS (SELECT unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
u AS (SELECT CASE WHEN starts_with(href, '/') THEN 'https://site.example' || href ELSE href END AS url FROM a)
SELECT lower(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1)) AS link_id, min(url) AS url FROM u WHERE regexp_matches(url, '^https://site\.example/[A-Za-z]') GROUP BY 1
""")
def extract_links(spark, d) -> DataFrame:
    return L.extract_links(_pages(spark, d), "https://site.example", r"^https://site\.example/[A-Za-z]")


@query(r"""
WITH a AS (SELECT unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT rtrim(lower(trim(href)), '/') AS url FROM a WHERE starts_with(rtrim(lower(trim(href)), '/'), '/th')
""")
def canonical_links(spark, d) -> DataFrame:
    return L.canonical_links(_pages(spark, d), "/th")


@query(r"""
WITH p AS (SELECT page_id AS page, unnest(CASE WHEN page_id % 97 = 96 THEN [NULL] ELSE regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) END) AS link FROM pages),
s AS (SELECT min(page) AS stop FROM (SELECT page, count(link) AS n FROM p GROUP BY page) WHERE n = 0)
SELECT link, min(page) AS page FROM p, s WHERE link IS NOT NULL AND (stop IS NULL OR page < stop) GROUP BY link
""")
def merge_result_pages(spark, d) -> DataFrame:
    rows = _pages(spark, d).select(F.col("page_id").alias("page"), F.explode(F.when(F.col("page_id") % 97 == 96, F.array(F.lit(None).cast("string"))).otherwise(L.hrefs(F.col("html")))).alias("link"))
    return L.merge_result_pages(rows)


@query(None)
def page_text(spark, d) -> DataFrame:
    return _pages(spark, d).select("page_id", L.page_text(F.col("html")).alias("text"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id AS id, pos::BIGINT AS pos, split_part(line, '.', 1) AS heading, CASE WHEN contains(line, '.') THEN trim(substr(line, length(split_part(line, '.', 1)) + 2)) ELSE '' END AS body FROM l WHERE trim(line) <> ''
""")
def text_sections(spark, d) -> DataFrame:
    return L.text_sections(_docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))


_RULES = [("trash|scum", "strong"), ("stupid|idiot|moron", "insult"), ("loser|clown", "mild")]


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)trash|scum') THEN 'strong' WHEN regexp_matches(text, '(?i)stupid|idiot|moron') THEN 'insult' WHEN regexp_matches(text, '(?i)loser|clown') THEN 'mild' END AS tone,
  CASE WHEN regexp_matches(text, '(?i)not |ikke ') THEN false WHEN regexp_matches(text, '(?i)the |und ') THEN true END AS stance, regexp_matches(text, '(?i)license') AS licensed
FROM documents
""")
def classify_prose(spark, d) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", P.first_match(t, _RULES).alias("tone"), P.tri_state(t, "not |ikke ", "the |und ").alias("stance"), P.mention(t, "license").alias("licensed"))


@query(r"""
SELECT doc_id, CASE WHEN n BETWEEN 1 AND 99999999 THEN n END AS amount FROM (
  SELECT doc_id, try_cast(nullif(regexp_replace(regexp_extract(text, '(?is)(?:call|tel|phone|at).{0,80}?(\d[\d .]*)', 1), '[^0-9]', '', 'g'), '') AS BIGINT) AS n FROM documents)
""")
def amount_near(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", P.amount_near(F.col("text"), "(?:call|tel|phone|at)").alias("amount"))


@query(None)
def classify_input(spark, d) -> DataFrame:
    return P.classify_input(L.text_sections(_docs(spark, d)), "^(the|die|les|la)", "license|trash")


@query(cte("findings") + "SELECT id, bool_and(good) AS ok, count(*) FILTER (NOT good) AS bad FROM (SELECT id, tg IN (2, 3) AND bygningsdel IN ('del0','del1','del2','del3','del4','del5','del6','del7','del8','del9') AND alvorlighet IN ('kosmetisk','mindre','vesentlig','alvorlig') AS good FROM findings) GROUP BY id")
def validate_findings(spark, d) -> DataFrame:
    return P.validated(bound(spark, d, "findings"), {"tg": (2, 3), "bygningsdel": tuple(f"del{i}" for i in range(10)), "alvorlighet": A.SEVERITY})


@query("""
WITH c AS (SELECT l_orderkey AS id, l_linenumber * 100000 + l_partkey AS rank, l_partkey AS candidate, CASE WHEN l_partkey % 9 = 0 THEN 'SE' ELSE 'NO' END AS country, cast(1000 + l_partkey % 40 AS VARCHAR) AS postcode,
  CASE WHEN l_orderkey % 5 <> 0 THEN cast(1000 + l_orderkey % 40 AS VARCHAR) END AS wanted, l_suppkey % 2 = 0 AS street_level, l_suppkey % 3 = 0 AS precise, CASE WHEN l_linenumber > 4 THEN 'fallback' ELSE 'main' END AS search FROM lineitem),
p AS (SELECT *, (wanted IS NULL OR coalesce(postcode = wanted, false)) AS strict, coalesce(street_level AND substr(postcode, 1, 2) = substr(wanted, 1, 2) AND (precise OR coalesce(postcode = wanted, false)), false) AS relaxed FROM c WHERE country = 'NO'),
q AS (SELECT *, CASE WHEN search = 'fallback' THEN CASE WHEN strict OR relaxed THEN 3 END WHEN strict THEN 1 WHEN relaxed THEN 2 END AS pass FROM p)
SELECT id, candidate, pass FROM q WHERE pass IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass, rank, candidate) = 1
""")
def choose_geocode(spark, d) -> DataFrame:
    k = F.col("l_orderkey")
    rows = read_table(spark, f"{d}/lineitem.parquet").select(
        k.alias("id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("rank"), F.col("l_partkey").alias("candidate"), F.when(F.col("l_partkey") % 9 == 0, "SE").otherwise("NO").alias("country"),
        (1000 + F.col("l_partkey") % 40).cast("string").alias("postcode"), F.when(k % 5 != 0, (1000 + k % 40).cast("string")).alias("wanted"), (F.col("l_suppkey") % 2 == 0).alias("street_level"), (F.col("l_suppkey") % 3 == 0).alias("precise"),
        F.when(F.col("l_linenumber") > 4, "fallback").otherwise("main").alias("search"),
    )
    return P.choose_geocode(rows)


def _donor_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    geo = bound(spark, d, "geo").withColumn("ord", F.col("id").cast("long"))
    pool = J.donor_candidates(geo).select(F.col("id").alias("peer_id"), F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng"), F.col("ord").alias("rank"), "ord")
    return geo, pool


@query(None)
def assign_donors(spark, d) -> DataFrame:
    """Donors of all rows, as one pass in id order would assign them; tested against a replay of that pass."""
    geo, pool = _donor_inputs(spark, d)
    return D.assign_donors(geo.select("id", "lat", "lng", "ord", "donor"), pool, 300.0)


@query(None)
def estimate_growing(spark, d) -> DataFrame:
    """Which rows would have to call if every caller could be reused by later rows; tested against a replay."""
    geo, _ = _donor_inputs(spark, d)
    return D.estimate_growing(geo.select("id", "lat", "lng", "ord", "donor"), 300.0)


@query(cte("listings", "geo") + """
, r AS (SELECT l.*, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.brj IS NOT NULL THEN s.brj ELSE g.brj END AS brj, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.mvv IS NOT NULL THEN s.mvv ELSE g.mvv END AS mvv
  FROM listings l LEFT JOIN geo g USING (id) LEFT JOIN geo s ON s.id = g.donor
  WHERE active AND lower(trim(coalesce(status, ''))) NOT IN ('solgt', 'inaktiv') AND pris <= 7500000 AND bra_i >= 40)
SELECT id, coalesce(trim(status), '') AS status, coalesce(trim(adresse), '') AS adresse, CASE WHEN postnummer IS NULL THEN '' ELSE lpad(postnummer, cast(greatest(4, length(postnummer)) AS INTEGER), '0') END AS postnummer,
  coalesce(pris, 0) AS pris, coalesce(CASE WHEN coalesce(bra_primary, bra_i, bra_total) > 0 THEN cast(round_even(pris::DOUBLE / coalesce(bra_primary, bra_i, bra_total)::DOUBLE, 0) AS BIGINT) END, 0) AS pris_kvm,
  coalesce(cast(bra_i AS VARCHAR), '') AS bra_i, coalesce(cast(bra_total AS VARCHAR), '') AS bra_total, coalesce(cast(byggeaar AS VARCHAR), '') AS byggeaar, coalesce(trim(boligtype), '') AS boligtype, coalesce(trim(eieform), '') AS eieform,
  coalesce(trim(energimerke), '') AS energimerke, coalesce(cast(brj AS VARCHAR), '') AS brj, coalesce(cast(mvv AS VARCHAR), '') AS mvv, trim(url) AS url, coalesce(trim(image_url), '') AS image_url
FROM r
""")
def publish_active(spark, d) -> DataFrame:
    """The visible active listings with donor-resolved commutes, in the published columns."""
    rows = O.visible_active(bound(spark, d, "listings")).withColumn("pris_kvm", S.price_per_m2("pris", "bra_primary", "bra_i", "bra_total"))
    return B.published(rows.join(J.resolve_donor(bound(spark, d, "geo")).select("id", "brj", "mvv"), "id", "left"))


_LINES = "lines AS (SELECT s_suppkey AS station_id, 'L' || cast(n_nationkey AS VARCHAR) AS line FROM supplier JOIN nation ON s_suppkey % 5 = n_nationkey % 5 AND s_suppkey % 7 <> 0), travel AS (SELECT station_id, line, dest AS destination, CASE WHEN (station_id + length(line) + length(dest)) % 6 <> 0 THEN 5 + (station_id * 7 + length(dest)) % 60 END AS minutes FROM lines, (VALUES ('brj'), ('mvvx')) v(dest))"


def _stations(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    stations = bound(spark, d, "stations")
    nation = read_table(spark, f"{d}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") % 5).alias("m"))
    lines = stations.filter("station_id % 7 != 0").select("station_id", (F.col("station_id") % 5).alias("m")).join(nation, "m").select("station_id", F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("line"))
    travel = lines.withColumn("destination", F.explode(F.array(F.lit("brj"), F.lit("mvvx"))))
    minutes = F.when((F.col("station_id") + F.length("line") + F.length("destination")) % 6 != 0, 5 + (F.col("station_id") * 7 + F.length("destination")) % 60)
    return stations, lines, travel.withColumn("minutes", minutes)


@query(cte("stations") + f""", {_LINES}
SELECT cast(s.station_id AS VARCHAR) AS station_id, name, coalesce(l.line, '') AS line, coalesce(cast(a.minutes AS VARCHAR), '') AS brj, coalesce(cast(b.minutes AS VARCHAR), '') AS mvvx
FROM stations s LEFT JOIN lines l ON l.station_id = s.station_id LEFT JOIN travel a ON a.station_id = l.station_id AND a.line = l.line AND a.destination = 'brj' LEFT JOIN travel b ON b.station_id = l.station_id AND b.line = l.line AND b.destination = 'mvvx'
""")
def publish_stations(spark, d) -> DataFrame:
    return B.station_table(*_stations(spark, d), ["brj", "mvvx"])


@query(cte("stations") + f""", {_LINES}
SELECT s.station_id, name, l.lines, t.brj, t.mvvx FROM stations s LEFT JOIN (SELECT station_id, list(DISTINCT line ORDER BY line) AS lines FROM lines GROUP BY 1) l USING (station_id)
LEFT JOIN (SELECT station_id, min(minutes) FILTER (destination = 'brj') AS brj, min(minutes) FILTER (destination = 'mvvx') AS mvvx FROM travel GROUP BY 1) t USING (station_id)
""")
def station_summary(spark, d) -> DataFrame:
    return B.station_summary(*_stations(spark, d)).select("station_id", "name", "lines", F.col("minutes")["brj"].alias("brj"), F.col("minutes")["mvvx"].alias("mvvx"))


@query(cte("listings", "listings_b") + """
SELECT 'a' AS bucket, id, pris, NULL AS hash_id FROM listings UNION ALL SELECT 'b', b_id, pris, 'b:' || substr(sha1(coalesce(url, '')), 1, 16) FROM listings_b
""")
def all_listings(spark, d) -> DataFrame:
    a = bound(spark, d, "listings").select("id", "pris")
    b = bound(spark, d, "listings_b").select(F.col("b_id").alias("id"), "pris", S.hash_id("url").alias("hash_id"))
    return B.all_listings(("a", a), ("b", b)).select("bucket", "id", "pris", "hash_id")
