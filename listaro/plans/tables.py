"""Queries over stated cost bands, areas, and sorted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.operators import areas as R
from listaro.operators import bands as B
from listaro.operators import places as L
from listaro.plans.bindings import BINDINGS, bound, cte
from listaro.staging import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Stated bands


#: A report's lines: one or two stated costs in each of several spellings, and costs that are none of the surveyor's.
BINDINGS["reports"] = (
    "lineitem",
    [
        "l_orderkey * 8 + l_linenumber AS id",
        "'Del ' || cast(l_linenumber AS string) || ' er slitt. ' || CASE l_partkey % 6 WHEN 0 THEN 'Kostnadsestimat: ' || cast(l_suppkey % 90 + 1 AS string) || ' 000 - ' || cast(l_suppkey % 90 + 1 + l_linenumber * 20 AS string) || ' 000' WHEN 1 THEN 'Sjablongmessig prisanslag gjelder: under kr ' || cast(l_suppkey % 400 + 1 AS string) || '.000'"
        " WHEN 2 THEN 'UTBEDRINGSKOSTNADEN over kr. ' || cast(l_suppkey % 400 + 1 AS string) || '000' WHEN 3 THEN 'Estimerte kostnader 5000 til 9000, kostnadsoverslag 150 000 – 250 000' WHEN 4 THEN 'Kostnadsestimat: ukjent, solgt for 900 000 - 950 000' ELSE 'Prisanslag: 90 000 - 20 000' END || '. Fra ' || cast(l_partkey % 100 + 1900 AS string) || '.' AS text",
        "CASE WHEN l_partkey % 6 = 3 THEN 'fast' ELSE 'egen' END AS kind", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
    ],
    None,
)

_GRID = f"[{', '.join(map(str, B.GRID))}]"
_LOW = f"coalesce(list_max(list_filter({_GRID}, lambda g: g <= a)), 0)::BIGINT"
_HIGH = f"coalesce(list_min(list_filter({_GRID}, lambda g: g >= b)), {B.GRID[-1]})::BIGINT"
_BANDS = f"""r AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_orderkey * 8 + l_linenumber AS id, l_orderkey AS report, l_partkey % 6 AS k, l_suppkey AS s, l_linenumber AS n, l_partkey AS part FROM lineitem),
raw AS (SELECT rid, report, part, 0 AS nth, (s % 90 + 1) * 1000 AS a, (s % 90 + 1 + n * 20) * 1000 AS b FROM r WHERE k = 0 UNION ALL SELECT rid, report, part, 0, 0, (s % 400 + 1) * 1000 FROM r WHERE k = 1
  UNION ALL SELECT rid, report, part, 0, (s % 400 + 1) * 1000, {B.GRID[-1]} FROM r WHERE k = 2 UNION ALL SELECT rid, report, part, 0, 5000, 9000 FROM r WHERE k = 3 UNION ALL SELECT rid, report, part, 1, 150000, 250000 FROM r WHERE k = 3),
bands AS (SELECT rid, report, part, nth, {_LOW} AS low, {_HIGH} AS high FROM raw)"""


@query("WITH " + _BANDS + """
SELECT r.id, coalesce((SELECT string_agg(low || '-' || high, ';' ORDER BY nth) FROM bands WHERE bands.rid = r.rid), '') AS bands,
  'Del ' || n || ' er slitt. ' || CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN ', ' WHEN 4 THEN 'Kostnadsestimat: ukjent, solgt for 900 000 - 950 000' ELSE '' END || '. Fra ' || (part % 100 + 1900) || '.' AS rest FROM r
""")
def stated_bands(spark, d) -> DataFrame:
    """Bands that the reports' lines state, on the grid, and the lines without them."""
    rows = bound(spark, d, "reports")
    bands = F.array_join(F.transform(B.stated_bands(F.col("text")), lambda b: F.concat_ws("-", b["low"].cast("string"), b["high"].cast("string"))), ";")
    return rows.select("id", bands.alias("bands"), B.without_stated(F.col("text")).alias("rest"))


_ESTIMATE = "(l_partkey * 7) % 8"


@query("WITH " + _BANDS + f""", grid AS (SELECT {_GRID} AS g),
st AS (SELECT report, low, high, row_number() OVER (PARTITION BY report ORDER BY low + high, low) AS place FROM bands),
es AS (SELECT report, low, high, row_number() OVER (PARTITION BY report ORDER BY low + high, low) AS place FROM (SELECT report, g[(part * 7) % 8 + 1]::BIGINT AS low, g[(part * 7) % 8 + 2]::BIGINT AS high FROM r, grid WHERE n <= 3)),
p AS (SELECT st.low AS sl, st.high AS sh, es.low AS el, es.high AS eh FROM st FULL JOIN es ON st.report = es.report AND st.place = es.place)
SELECT count(*) FILTER (sl IS NOT NULL AND el IS NOT NULL) AS pairs, count(*) FILTER (sl = el AND sh = eh) AS exact, count(*) FILTER (abs(list_position(g, sl) - list_position(g, el)) <= 1 AND abs(list_position(g, sh) - list_position(g, eh)) <= 1) AS within_one,
  count(*) FILTER (el + eh > sl + sh) AS higher, count(*) FILTER (el + eh < sl + sh) AS lower, count(*) FILTER (el IS NULL) AS stated_unmatched, count(*) FILTER (sl IS NULL) AS estimated_unmatched FROM p, grid
""")
def band_report(spark, d) -> DataFrame:
    """How estimated bands of the reports compare to those that their texts state."""
    rows = bound(spark, d, "reports")
    stated = rows.select("l_orderkey", F.explode(B.stated_bands(F.col("text"))).alias("b")).select("l_orderkey", "b.low", "b.high")
    grid = F.array(*[F.lit(g).cast("long") for g in B.GRID])
    at = F.expr(_ESTIMATE).cast("int")
    return B.band_report(stated, rows.filter("l_linenumber <= 3").select("l_orderkey", F.get(grid, at).alias("low"), F.get(grid, at + 1).alias("high")), "l_orderkey")


# Areas


#: Corners of a star, in hundredths of a degree from its middle; the third is no number and is skipped.
_NO_NUMBER = "double('NaN')"
_STAR = [(8, 1), (2, 2), (None, 5), (1, 9), (-2, 2), (-9, 1), (-2, -1), (-4, -8), (1, -2), (7, -7), (2, -1)]


def _corner(i: int) -> tuple[str, str]:
    """SQL of a corner for nation n_nationkey: stars of several sizes, some of which overlap."""
    x, y = _STAR[i]
    scale = "(1 + n_nationkey % 3)"
    return f"10.1e0 + n_nationkey * 53 % 130 / 1e2 + {scale} * {x or 0} / 1e2", f"59.6e0 + n_nationkey * 29 % 60 / 1e2 + {scale} * {y} / 1e2"


def _stars(spark, d) -> DataFrame:
    corners = ", ".join(f"named_struct('lng', {_corner(i)[0] if x is not None else _NO_NUMBER}, 'lat', {_corner(i)[1]})" for i, (x, _) in enumerate(_STAR))
    return read_table(spark, f"{d}/nation.parquet").selectExpr("n_nationkey AS area", f"array({corners}) AS corners")


_KEPT = [i for i, (x, _) in enumerate(_STAR) if x is not None]
_EDGES = " + ".join(
    f"(CASE WHEN ((y{a} > lat) <> (y{b} > lat)) AND lng < (x{b} - x{a}) * (lat - y{a}) / (CASE WHEN y{b} - y{a} = 0 THEN 1e-12 ELSE y{b} - y{a} END) + x{a} THEN 1 ELSE 0 END)"
    for a, b in zip(_KEPT, [_KEPT[-1], *_KEPT[:-1]])
)
_STAR_SQL = "stars AS (SELECT n_nationkey AS area, " + ", ".join(f"{_corner(i)[0]} AS x{i}, {_corner(i)[1]} AS y{i}" for i in _KEPT) + " FROM nation)"


@query(cte("geo") + f", {_STAR_SQL} SELECT id, area FROM geo, stars WHERE lat IS NOT NULL AND lng IS NOT NULL AND ({_EDGES}) % 2 = 1")
def in_areas(spark, d) -> DataFrame:
    """Which of many areas each listing lies in."""
    return R.in_areas(bound(spark, d, "geo").select("id", "lng", "lat"), _stars(spark, d))


_POPULATIONS = "SELECT CASE WHEN active THEN 'active' ELSE 'closed' END AS source, l.id, lng, lat FROM listings l JOIN geo USING (id) UNION ALL SELECT 'b', b_id, lng, lat FROM listings_b"


@query(cte("listings", "geo", "listings_b") + f", {_STAR_SQL}, p AS ({_POPULATIONS}) SELECT source, id FROM p WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stars WHERE ({_EDGES}) % 2 = 1)")
def outside_areas(spark, d) -> DataFrame:
    """Active, closed and second-source listings with a known place outside all areas."""
    a = bound(spark, d, "listings").select("id", F.when(F.col("active"), "active").otherwise("closed").alias("source")).join(bound(spark, d, "geo").select("id", "lng", "lat"), "id")
    b = bound(spark, d, "listings_b").select(F.lit("b").alias("source"), F.col("b_id").alias("id"), "lng", "lat")
    return R.outside(a.select("source", "id", "lng", "lat").unionByName(b), _stars(spark, d)).select("source", "id")


# Sorted tables


_SEVERITIES = ("kosmetisk", "mindre", "vesentlig", "alvorlig")
_TOWNS = "CASE o_orderkey % 9 WHEN 0 THEN 'Ås' WHEN 1 THEN 'ærlig' WHEN 2 THEN 'Øyer' WHEN 3 THEN ' bergen' WHEN 4 THEN 'Bergen' WHEN 5 THEN '' WHEN 6 THEN 'zoo' WHEN 7 THEN 'Élan' END || CASE WHEN o_orderkey % 9 = 5 THEN ' ' ELSE cast(o_custkey % 10 AS {text}) END"
BINDINGS["towns"] = ("orders", ["o_orderkey AS id", _TOWNS.replace("{text}", "string") + " AS town", "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE o_orderkey % 7 WHEN 0 THEN 'Alvorlig' WHEN 1 THEN 'mindre' WHEN 2 THEN ' kosmetisk ' WHEN 3 THEN 'vesentlig' WHEN 4 THEN 'ukjent' END AS severity"], None)
_TOWN_KEY = "nullif(translate(lower(trim(town)), 'æäøöåéèêüáàóò', '{{||}eeeuaaoo'), '')"
_RANK = "list_position(['kosmetisk', 'mindre', 'vesentlig', 'alvorlig'], lower(trim(severity)))"


@query(f"WITH t AS (SELECT o_orderkey AS id, {_TOWNS.replace('{text}', 'VARCHAR')} AS town, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS price, CASE o_orderkey % 7 WHEN 0 THEN 'Alvorlig' WHEN 1 THEN 'mindre' WHEN 2 THEN ' kosmetisk ' WHEN 3 THEN 'vesentlig' WHEN 4 THEN 'ukjent' END AS severity FROM orders) "
    + " UNION ALL ".join(f"SELECT '{name} {way}' AS page, row_number() OVER (ORDER BY {key} {way} NULLS LAST, id) AS place, id FROM t" for name, key in (("town", _TOWN_KEY), ("price", "price"), ("severity", _RANK)) for way in ("asc", "desc")))
def sorted_tables(spark, d) -> DataFrame:
    """Every row's place in the table sorted by text, number and severity, up and down."""
    rows = bound(spark, d, "towns")
    out = None
    for name, key in (("town", L.text_key(F.col("town"))), ("price", F.col("price")), ("severity", L.rank_key(F.col("severity"), _SEVERITIES))):
        for way in ("asc", "desc"):
            page = L.sort_table(rows, key, way == "desc").select(F.lit(f"{name} {way}").alias("page"), "place", "id")
            out = page if out is None else out.unionByName(page)
    return out
