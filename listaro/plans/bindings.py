"""The listing domain's tables, derived from the star-schema tables by one projection each.

A binding is a source table, the columns as SQL expressions that both Spark and
DuckDB read, and an optional filter. Fractional literals are doubles, so both
engines do the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listaro.staging import read_table, shuffle_width

_LAT = "59.6e0 + (({k} {{div}} 8) * 7919 % 6000) / 1e4 + ({k} % 8) * 6e-4"
_LNG = "10e0 + (({k} {{div}} 8) * 10473 % 15000) / 1e4 + (({k} * 3) % 8) * 1e-3"
_MINUTES = "CASE WHEN {k} % {m} = 0 THEN NULL WHEN {k} % {m} = 1 THEN -1 WHEN {k} % {m} = 2 THEN -2 ELSE cast(10 + ({k} * {f}) % 110 as int) END"

BINDINGS: dict[str, tuple[str, list[str], str | None]] = {
    "listings": (
        "orders",
        [
            "cast(o_orderkey as string) AS id",
            "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE cast(floor(o_totalprice) as bigint) * 40 END AS pris",
            "CASE o_orderstatus WHEN 'F' THEN 'Solgt' WHEN 'P' THEN ' Inaktiv' END AS status",
            "(o_orderstatus = 'O' OR o_orderkey % 29 = 0) AS active",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 30 + (o_orderkey * 37) % 150 END AS bra_i",
            "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 25 + (o_orderkey * 41) % 140 END AS bra_primary",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 40 + (o_orderkey * 43) % 160 END AS bra_total",
            "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE cast(o_custkey % 9999 as string) END AS postnummer",
            "CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN '' ELSE 'storgata ' || cast(o_custkey % 300 as string) || CASE o_orderkey % 6 WHEN 0 THEN 'b - prosjekt' WHEN 1 THEN ' (bolignr. h-02)' WHEN 2 THEN 'a [leil. 3]' WHEN 3 THEN ' /nr 2' ELSE '' END END AS adresse",
            "'https://listing.example/' || CASE o_orderkey % 13 WHEN 0 THEN 'NewBuildings' WHEN 1 THEN 'lettings' ELSE 'homes' END || '/ad.html?id=' || cast(o_orderkey as string) AS url",
            "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast(1900 + o_orderkey % 125 as int) END AS byggeaar",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS boligtype",
            "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'A' ELSE 'C' END AS energimerke",
            "CASE o_orderkey % 3 WHEN 0 THEN 'Eier' WHEN 1 THEN 'Andel' END AS eieform",
            "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast(o_orderkey % 6 as int) END AS soverom",
            "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE cast(floor(o_totalprice) as bigint) * 42 END AS totalpris",
            "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1500 + o_orderkey % 5000 END AS felleskost_mnd",
            "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 9000 + o_orderkey % 7001 END AS kommunale_avg_aar",
            "CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 12 = 1 THEN ' ' ELSE 'https://img.example/' || cast(o_orderkey as string) END AS image_url",
            "o_orderdate AS scraped_at",
            "o_orderdate + {days:o_orderkey % 200} AS updated_at",
        ],
        None,
    ),
    "geo": (
        "orders",
        [
            "cast(o_orderkey as string) AS id",
            f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_LAT.format(k='o_orderkey')} END AS lat",
            f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_LNG.format(k='o_orderkey')} END AS lng",
            f"{_MINUTES.format(k='o_orderkey', m=17, f=31)} AS brj",
            f"{_MINUTES.format(k='o_orderkey', m=19, f=29)} AS mvv",
            "CASE WHEN o_orderkey % 7 = 0 AND o_orderkey > 0 THEN cast(o_orderkey - 1 as string) WHEN o_orderkey % 43 = 0 THEN ' ' END AS donor",
            "cast(CASE WHEN o_orderkey % 53 = 0 THEN 1 ELSE 0 END as int) AS geocode_failed",
        ],
        None,
    ),
    "sold": (
        "orders",
        [
            "cast(o_orderkey as string) AS id",
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(floor(o_totalprice) as bigint) * 41 END AS sold_price",
            "o_orderdate + {days:o_orderkey % 90} AS sold_at",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(floor(o_totalprice) as bigint) * 40 END AS price_suggestion",
            "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 30 + (o_orderkey * 37) % 150 END AS size",
            "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE (o_orderkey * 1000) % 700000 END AS collective_debt",
            "CASE WHEN o_orderkey % 3 = 0 THEN cast(o_custkey as string) END AS near_id",
        ],
        "o_orderstatus <> 'O' AND o_orderkey % 6 <> 1",
    ),
    "attempts": ("orders", ["cast(o_orderkey as string) AS id", "cast(o_orderkey % 7 as int) AS attempts"], "o_orderkey % 2 = 0"),
    "listings_b": (
        "customer",
        [
            "'https://B.example/Homes/' || cast(c_custkey as string) || CASE WHEN c_custkey % 4 = 0 THEN '/' ELSE '' END AS url",
            "cast(c_custkey as string) AS b_id",
            "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Storgata ' || cast(c_custkey % 300 as string) || '.' ELSE 'Bakken ' || cast(c_custkey as string) END AS adresse",
            "cast(c_custkey % 9999 as string) || CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END AS postnummer",
            "CASE WHEN c_acctbal < 0 THEN NULL ELSE cast(floor(c_acctbal) as bigint) * 800 END AS pris",
            f"CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE {_LAT.format(k='c_custkey')} END AS lat",
            f"CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE {_LNG.format(k='c_custkey')} END AS lng",
            "CASE WHEN c_custkey % 5 = 0 THEN cast(c_custkey as string) WHEN c_custkey % 5 = 1 THEN ' ' END AS duplicate_of",
            "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 7 <> 0 END AS active",
            "c_mktsegment AS boligtype",
        ],
        None,
    ),
    "stations": (
        "supplier",
        [
            "s_suppkey AS station_id",
            "s_name AS name",
            f"{_LAT.format(k='(s_suppkey * 11)')} AS lat",
            f"{_LNG.format(k='(s_suppkey * 11)')} AS lng",
            "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 400 + (s_suppkey % 5) * 300 END AS radius_m",
        ],
        None,
    ),
    "findings": (
        "lineitem",
        [
            "cast(l_orderkey as string) AS id",
            "l_linenumber AS pos",
            "cast(2 + l_linenumber % 2 as int) AS tg",
            "'del' || cast(l_partkey % 12 as string) AS bygningsdel",
            "CASE WHEN l_returnflag = 'R' THEN 'alvorlig' WHEN l_returnflag = 'A' THEN 'vesentlig' WHEN l_linestatus = 'F' THEN 'mindre' ELSE 'kosmetisk' END AS alvorlighet",
            "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE cast(floor(l_quantity) as bigint) * 1000 END AS kostnad_lav",
            "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE cast(floor(l_quantity) as bigint) * 2500 END AS kostnad_hoy",
            "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN 'takst' WHEN l_orderkey % 3 = 1 THEN 'estimat' WHEN l_linenumber % 2 = 0 THEN 'takst' ELSE 'estimat' END AS kostnad_kilde",
        ],
        None,
    ),
    "facilities": ("lineitem", ["cast(l_orderkey as string) AS id", "CASE WHEN l_quantity > 25 THEN 'Balkong' WHEN l_quantity > 12 THEN 'heis' ELSE l_returnflag || l_linestatus END AS facility"], None),
    "observations": ("events", ["cast(user_id as string) AS id", "ts AS observed_at", "event_id", "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ' ' || event_type ELSE event_type END AS status"], None),
    "ledger": ("events", ["event_id", "ts AS called_at", "event_type AS api", "CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'blocked' ELSE 'ok' END AS outcome"], None),
}


#: Tables of whole pages, made from narrow rows.
PAGES = {"listing_pages", "ad_pages"}


def _render(text: str, spark: bool) -> str:
    text = text.replace("{div}", "div" if spark else "//")
    while "{days:" in text:
        head, rest = text.split("{days:", 1)
        n, tail = rest.split("}", 1)
        text = head + (f"make_dt_interval(cast({n} as int))" if spark else f"to_days(cast({n} as int))") + tail
    return text


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the driver's tables; only the columns that a plan uses reach the scan."""
    source, columns, where = BINDINGS[name]
    table = read_table(spark, f"{sf_dir}/{source}.parquet")
    table = table.where(_render(where, True)) if where else table
    # Pages are far larger than the rows they are made from, so the table's few files don't say how many tasks they need.
    table = table.repartition(shuffle_width(spark)) if name in PAGES else table
    return table.selectExpr(*[_render(c, True) for c in columns])


def cte(*names: str) -> str:
    """The same tables as a WITH clause for DuckDB."""
    parts = []
    for name in names:
        source, columns, where = BINDINGS[name]
        parts.append(f"{name} AS (SELECT {', '.join(_render(c, False) for c in columns)} FROM {source}{' WHERE ' + where if where else ''})")
    return "WITH " + ", ".join(parts) + " "


def as_of():
    """The instant that stands for now in every query; no operator reads the clock."""
    return F.lit("1998-12-01 00:00:00").cast("timestamp")


AS_OF_SQL = "TIMESTAMP '1998-12-01 00:00:00'"
