"""Queries over scoped prose, postcodes, circles, snapshots, metrics by day, and calls without a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import control as C
from listaro.operators import facts as T
from listaro.operators import merge as M
from listaro.operators import parsing as X
from listaro.operators import prose as P
from listaro.operators import ranking as R
from listaro.plans import nightly
from listaro.plans.bindings import bound, cte
from listaro.staging import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Turns of conversations as a prospectus' sections: some with a heading on the topic, attachment lists among the others.
_HEADING = "CASE WHEN conv_id % 3 <> 0 AND role = 'user' THEN 'Om ferdigattest og tillatelser' WHEN turn % 4 = 3 THEN 'Vedlegg' ELSE role END"
_BODY = "coalesce(text, '') || CASE WHEN turn % 4 = 3 THEN ' Ferdigattest foreligger ikke. ' WHEN turn % 4 = 1 THEN ' Ferdigattest er gitt. ' ELSE ' Ferdigattest mangler. ' END"


@query(f"""
WITH s AS (SELECT conv_id AS id, turn AS pos, {_HEADING} AS heading, {_BODY} AS body FROM conversations), t AS (SELECT id, bool_or(heading LIKE 'Om ferdig%') AS topical FROM s GROUP BY id)
SELECT id, sha256(coalesce(string_agg(body, chr(10) ORDER BY pos, body) FILTER (CASE WHEN topical THEN heading LIKE 'Om ferdig%' ELSE heading <> 'Vedlegg' END), '')) AS text_sha256,
  CASE WHEN bool_or(body LIKE '%mangler%' OR body LIKE '%foreligger ikke%') FILTER (CASE WHEN topical THEN heading LIKE 'Om ferdig%' ELSE heading <> 'Vedlegg' END) THEN 'ingen'
    WHEN bool_or(body LIKE '%er gitt%') FILTER (CASE WHEN topical THEN heading LIKE 'Om ferdig%' ELSE heading <> 'Vedlegg' END) THEN 'ferdigattest' END AS certificate
FROM s JOIN t USING (id) GROUP BY id
""")
def scoped_prose(spark, d) -> DataFrame:
    """The certificate as the sections on that topic state it, or else all sections but attachment lists."""
    rows = read_table(spark, f"{d}/conversations.parquet").selectExpr("conv_id AS id", "turn AS pos", f"{_HEADING} AS heading", f"{_BODY} AS body")
    scoped = P.scoped_text(rows, "ferdigattest", "vedlegg")
    return scoped.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), T.certificate(F.col("text")).alias("certificate"))


_RAW = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'N-' || cast(o_custkey % 9999 AS {text}) WHEN 3 THEN cast(o_custkey % 99 AS {text}) || ' ' WHEN 4 THEN 'Ukjent' WHEN 5 THEN cast(o_custkey AS {text}) || '0000' ELSE cast(o_custkey % 9999 AS {text}) END"


@query(f"WITH r AS (SELECT o_orderkey AS id, trim({_RAW.replace('{text}', 'VARCHAR')}) AS s FROM orders) SELECT id, CASE WHEN coalesce(s, '') = '' THEN NULL WHEN regexp_replace(s, '[^0-9]', '', 'g') = '' THEN lower(s) WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) <= 4 THEN lpad(regexp_replace(s, '[^0-9]', '', 'g'), 4, '0') ELSE lower(s) END AS postcode FROM r")
def postcode_digits(spark, d) -> DataFrame:
    """Postcodes by their digits alone."""
    return read_table(spark, f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), S.postcode_digits(F.expr(_RAW.replace("{text}", "string"))).alias("postcode"))


_RING = "sin(radians(lat)) * cos(radius_m / 6371000.0::DOUBLE) + cos(radians(lat)) * sin(radius_m / 6371000.0::DOUBLE) * cos(b)"


@query(cte("stations") + f"""
, c AS (SELECT station_id, i, lat, lng, radius_m::DOUBLE AS radius_m, i * (2 * 3.141592653589793::DOUBLE / 8) AS b FROM stations, range(9) r(i) WHERE radius_m IS NOT NULL)
SELECT station_id, i::INT AS i, round(degrees(asin({_RING})), 6) AS lat, round(degrees(radians(lng) + atan2(sin(b) * sin(radius_m / 6371000.0::DOUBLE) * cos(radians(lat)), cos(radius_m / 6371000.0::DOUBLE) - sin(radians(lat)) * ({_RING}))), 6) AS lng FROM c
""")
def station_circles(spark, d) -> DataFrame:
    """Each station's reach as a ring of eight corners, the first again at the end."""
    rows = bound(spark, d, "stations").filter("radius_m is not null")
    ring = rows.select("station_id", F.posexplode(S.circle("lat", "lng", "radius_m", 8)).alias("i", "p"))
    return ring.select("station_id", "i", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query("""
WITH m AS (SELECT ts::DATE AS day, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS sold FROM events GROUP BY 1)
SELECT day, CASE WHEN day(day) % 3 = 0 THEN events * 2 ELSE events END AS events, CASE WHEN day(day) % 3 = 0 THEN 0 ELSE sold END AS sold FROM m WHERE day(day) <> 1 OR day(day) % 3 = 0
""")
def replaced_metrics(spark, d) -> DataFrame:
    """Daily metrics, where days that are worked out again take the place of the old ones."""
    daily = read_table(spark, f"{d}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("sold")).filter(F.dayofmonth("day") != 1)
    again = daily.filter(F.dayofmonth("day") % 3 == 0).select("day", (F.col("events") * 2).alias("events"), F.lit(0).cast("long").alias("sold"))
    return M.keyed_replace(daily, again, "day")


@query(cte("geo") + "SELECT id, 'brj' AS destination FROM geo WHERE brj IS NULL UNION ALL SELECT id, 'mvv' FROM geo WHERE mvv IS NULL")
def unlimited_calls(spark, d) -> DataFrame:
    """All calls for unknown values, as a limit of 0 is none."""
    return R.limit_calls(bound(spark, d, "geo"), ("brj", "mvv"), 0)


# Messages and sale cards


@query("""
WITH w AS (SELECT date_trunc('week', ts)::DATE AS week, count(*) FILTER (event_type = 'view') AS added, count(*) FILTER (event_type = 'purchase') AS sold, count(*) FILTER (event_type = 'error' AND event_id % 3 = 0) AS priced, count(*) FILTER (event_type = 'error') AS total FROM events GROUP BY 1)
SELECT week, '📅 This week: +' || added || ' added, ' || sold || ' sold.' AS weekly,
  CASE WHEN day(week) % 2 = 0 THEN '💰 Sold prices: SUSPENDED (throttled) — ' ELSE '💰 Sold prices: +' || sold || ' today, ' END || priced || '/' || total || ' (' || cast(floor(priced / total::DOUBLE * 100 + 0.5) AS BIGINT) || '%) covered.' AS progress FROM w
""")
def weekly_messages(spark, d) -> DataFrame:
    """The week's text, and how far sold prices are known."""
    kind = F.col("event_type")
    weeks = read_table(spark, f"{d}/events.parquet").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        F.count_if(kind == "view").alias("added"), F.count_if(kind == "purchase").alias("sold"), F.count_if((kind == "error") & (F.col("event_id") % 3 == 0)).alias("priced"), F.count_if(kind == "error").alias("total"))
    return weeks.select("week", C.weekly_message(F.col("added"), F.col("sold")).alias("weekly"), C.progress_message(F.dayofmonth("week") % 2 == 0, F.col("sold"), F.col("priced"), F.col("total")).alias("progress"))


@query(f"""WITH f AS ({nightly.SQL['drift_findings']})
SELECT batch, 'Parser drift: ' || count(*) || ' field(s)' || chr(10) || string_agg("column" || '  ' || printf('%.1f', floor(base_rate * 1000 + 0.5) / 10) || '% -> ' || printf('%.1f', floor(rate * 1000 + 0.5) / 10) || '%  (n=' || n || ')', chr(10) ORDER BY "column") AS message FROM f GROUP BY batch
""")
def drift_texts(spark, d) -> DataFrame:
    """The alert of each batch in which a field drifted."""
    return C.drift_messages(nightly.drift_findings(spark, d), "batch")


_CARD = "'{\"docs\":[{\"adId\":' || cast(o_orderkey AS string) || ',\"address\":\"Vei ' || cast(o_custkey AS string) || '\",\"cadastralSoldPrice\":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE cast(o_orderkey * 100 AS string) END || ',\"cadastralSoldDate\":\"2021-0' || cast(o_orderkey % 9 + 1 AS string) || '-11\",\"priceSuggestion\":' || cast(o_orderkey * 90 AS string) || ',\"soldDate\":\"2020-01-0' || cast(o_orderkey % 9 + 1 AS string) || '\",\"propertyType\":\"Leilighet\",\"size\":' || cast(o_orderkey % 200 AS string) || ',\"bedrooms\":' || cast(o_orderkey % 6 AS string) || ',\"collectiveDebt\":' || cast(o_orderkey % 7000 AS string) || ',\"ownershipType\":\"Andel\",\"more\":[1]},{\"address\":\"no key\"}]}'"


@query("SELECT cast(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 100 END AS sold_price, '2021-0' || (o_orderkey % 9 + 1) || '-11' AS registered_date, '2020-01-0' || (o_orderkey % 9 + 1) AS sold_date, o_orderkey * 90 AS price_suggestion, 'Vei ' || o_custkey AS address, (o_orderkey % 200)::INT AS size, 'Leilighet' AS kind, (o_orderkey % 6)::INT AS bedrooms, o_orderkey % 7000 AS collective_debt, 'Andel' AS ownership FROM orders WHERE o_orderkey % 13 <> 0")
def sale_card_fields(spark, d) -> DataFrame:
    """All columns of the sale cards; bodies that are no JSON have none."""
    return X.sale_cards(read_table(spark, f"{d}/orders.parquet").selectExpr(f"CASE WHEN o_orderkey % 13 = 0 THEN '<html>' ELSE {_CARD} END AS body"))
