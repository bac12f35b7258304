"""Queries over whole listing pages: every field, in markup of many shapes.

The pages are written from the orders: each expected value is a column of the
order, and the markup around it varies with the key (order and quoting of
attributes, nesting, upper case, missing parts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.operators import parsing as P
from listaro.plans.bindings import BINDINGS, bound

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _element(tag: str, attribute: str, value: str, body: str, shape: str = "k % 4") -> str:
    """SQL of an element whose attribute stands in one of four shapes; ``body`` is SQL."""
    starts = [f'<{tag} class="a b" {attribute}="{value}">', f"<{tag.upper()} {attribute}='{value}' hidden>", f"<{tag}\n id=x {attribute} = {value} >" if " " not in value else f'<{tag} {attribute}="{value}"\t>', f'<{tag} data-note="1 > 0" {attribute}="{value}" class=c>']
    cases = " ".join(f"WHEN {i} THEN {_text(s)}" for i, s in enumerate(starts[:3]))
    return f"(CASE {shape} {cases} ELSE {_text(starts[3])} END || {body} || {_text(f'</{tag}>')})"


def _if(condition: str, sql: str) -> str:
    return f"(CASE WHEN {condition} THEN {sql} ELSE '' END)"


def _kr(n: str) -> str:
    """An amount of thousands in one of three spellings."""
    return f"(cast({n} AS string) || CASE k % 3 WHEN 0 THEN '&nbsp;000 kr' WHEN 1 THEN ' 000&#160;kr per år' ELSE '000 kr' END)"


def _area(name: str, test_id: str, every: int, plus: str = "''") -> str:
    return _if(f"k % {every} <> 0", _element("div", "data-testid", test_id, f"'<div><dt>{name}</dt><DD>' || cast(k % 200 + {every} AS string) || ' m²' || {plus} || '</DD></div>'"))


_AREA_ROWS = [("BRA-i", "info-usable-i-area", 5), ("BRA", "info-usable-area", 6), ("BRA-e", "info-usable-e-area", 7), ("BRA-b", "info-usable-b-area", 8), ("TBA", "info-open-area", 9), ("Brutto", "info-gross-area", 11)]
_TARGETING = """'<script type=application/json id=advertising-initial-state>{"config":{"adServer":{"gam":{"targeting":[{"key":"bedrooms","value":["' || cast(k % 6 AS string) || '"]},{"key":"rooms","value":["' || cast(k % 9 AS string) || '","x"]},{"key":"floor","value":[' || CASE WHEN k % 4 = 0 THEN '' ELSE '"' || cast(k % 13 AS string) || '"' END || ']},{"key":"primary_size","value":["' || cast(k % 90 AS string) || ' m2"]},{"key":"ownership_type","value":["STOCK"]}]}}}}</script>'"""

_PARTS = [
    _text('<!DOCTYPE html><html><head><!-- <h1>no</h1> <div data-testid="info-open-area">9 m²</div> --><style>div > p {}</style>'),
    _if("k % 10 < 3", "'<meta content=\"https://img.example/a?x=1&amp;y=' || cast(k AS string) || '\" property=\"og:image\">'"),
    _if("k % 10 = 3", "'<META name=''og:image'' content=''/relative''><meta name=\"twitter:image\" content=\"http://img.example/t' || cast(k AS string) || '\">'"),
    _text("</head><body>"), _TARGETING,
    _if("k % 8 = 1", "'<div class=\"text-xs inline-flex bg-[--w-color-badge-negative-background] s-text\"> Solgt </div>'"),
    _if("k % 16 IN (1, 2)", "'<div class=\"inline-flex bg-[--w-color-badge-warning-background]\"><span>Inaktiv</span></div>'"),
    _element("h1", "id", "title", "'Hus <b>nr ' || cast(k AS string) || '</b>, 1234 By &amp; land'"),
    _if("k % 5 <> 0", _element("span", "data-testid", "object-address", "CASE WHEN k % 5 = 1 THEN ' ' ELSE 'Storgata ' || cast(c AS string) || ' B, ' END || lpad(cast(c % 10000 AS string), 4, '0') || ' Oslo'")),
    _if("k % 7 > 1", _element("div", "data-testid", "pricing-total-price", "'<dt>Totalpris</dt><dd>' || " + _kr("p") + " || '</dd>'")),
    _if("k % 7 > 0", _element("div", "data-testid", "pricing-incicative-price", "'Prisantydning <span>' || " + _kr("p + 1") + " || '</span>'")),
    *[_area(*row) for row in _AREA_ROWS],
    _area("Tomt", "info-plot-area", 10, "CASE WHEN k % 3 = 0 THEN ' ( eiet )' WHEN k % 3 = 1 THEN ' (festet)' ELSE '' END"),
    _if("k % 4 = 0", _element("div", "data-testid", "info-primary-area", "'P-rom 77 m²'")),
    _if("k % 12 <> 0", _element("div", "data-testid", "info-construction-year", "'Byggeår ' || cast(1900 + k % 120 AS string)")),
    _if("k % 9 <> 0", _element("div", "data-testid", "info-property-type", "CASE WHEN k % 2 = 0 THEN '<dl><dt>Boligtype</dt><dd> Leilighet </dd></dl>' ELSE ' Ene&nbsp;bolig ' END")),
    _if("k % 3 <> 0", _element("div", "data-testid", "info-ownership-type", "'<dl><dt>Eieform</dt><dd>' || CASE WHEN k % 3 = 1 THEN 'Eier (selveier)' ELSE ' Andel ' END || '</dd></dl>'")),
    _if("k % 5 <> 2", _element("span", "data-testid", "local-area-name", "' Nabolag&nbsp;' || cast(c % 50 AS string)")),
    _if("k % 6 <> 0", _element("div", "data-testid", "energy-label", "'<span>Energimerking</span> ' || CASE k % 6 WHEN 1 THEN 'A - Mørkegrønn' WHEN 2 THEN '- Oransje' WHEN 3 THEN 'C' ELSE '' END || CASE WHEN k % 6 IN (2, 4) THEN '<svg role=img aria-label=\"Energimerke E\"><path d=\"M0\"/></svg>' ELSE '' END")),
    _element("section", "data-testid", "pricing-details", "'<dl>' || " + " || ".join(_if(f"k % {i + 3} <> 0", f"'<div><dt>{label}</dt> <dd><b>' || {_kr(f'(k % 500 + {i})')} || '</b></dd></div>'") for i, label in enumerate(P.MONEY)) + " || '<dt>Annet</dt><dd>ukjent</dd></dl>'"),
    _if("k % 7 <> 3", _element("section", "data-testid", "object-facilities", "'<h2>Fasiliteter</h2><div><div>Balkong</div><div> Heis </div><div>Balkong</div><div></div><div>Nr &amp; ' || cast(c % 7 AS string) || '</div></div>'")),
    _if("k % 7 <> 4", _element("section", "data-testid", "cadastre-info", "'<div>' || " + " || ".join(_if(f"k % {i + 2} <> 0", f"'<div>{label} : <span>' || cast(k % 1000 + {i} AS string) || ' </span></div>'") for i, label in enumerate(P.REGISTRY)) + " || '<div>Uten verdi:</div></div>'")),
    _if("k % 10 = 4", "'<p>https://images.example.org/x' || cast(k AS string) || '.jpg and more</p>'"),
    _text("</body></html>"),
]

_K = {"k": "o_orderkey", "c": "o_custkey", "p": "cast(floor(o_totalprice) AS bigint)"}


def _over_orders(sql: str) -> str:
    """k, c and p as columns of the orders."""
    import re

    out = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(x if i % 2 else re.sub(r"\b[kcp]\b", lambda m: _K[m[0]], x) for i, x in enumerate(out))


BINDINGS["listing_pages"] = ("orders", ["cast(o_orderkey as string) AS id", "'https://listing.example/' || cast(o_orderkey as string) AS url", _over_orders(" || ".join(_PARTS)) + " AS html"], None)

_AREA = "CASE WHEN k % {1} <> 0 THEN cast(k % 200 + {1} AS VARCHAR) ELSE '' END AS {0}"


@query("WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, cast(floor(o_totalprice) AS BIGINT) AS p FROM orders) SELECT cast(k AS VARCHAR) AS id, CASE WHEN k % 16 IN (1, 2) THEN 'Inaktiv' WHEN k % 8 = 1 THEN 'Solgt' END AS status,"
    " CASE WHEN k % 5 = 0 THEN 'Hus nr ' || k || ', 1234 By & land' WHEN k % 5 > 1 THEN 'Storgata ' || c || ' B' END AS address, CASE WHEN k % 5 = 0 THEN '1234' ELSE lpad(cast(c % 10000 AS VARCHAR), 4, '0') END AS postcode,"
    " CASE WHEN k % 7 > 1 THEN p * 1000 WHEN k % 7 = 1 THEN p * 1000 + 1000 END AS price, 'https://listing.example/' || k AS url,"
    " CASE WHEN k % 10 < 3 THEN 'https://img.example/a?x=1&y=' || k WHEN k % 10 = 3 THEN 'http://img.example/t' || k WHEN k % 10 = 4 THEN 'https://images.example.org/x' || k || '.jpg' ELSE '' END AS image_url,"
    " CASE WHEN k % 4 = 0 THEN '77' ELSE cast(k % 90 AS VARCHAR) || '2' END AS primary_area, "
    + ", ".join(_AREA.format(*x) for x in (("bra_i", 5), ("bra", 6), ("bra_e", 7), ("bra_b", 8), ("tba", 9), ("plot_area", 10), ("gross_area", 11)))
    + ", CASE WHEN k % 10 = 0 THEN '' WHEN k % 3 = 0 THEN 'eiet' WHEN k % 3 = 1 THEN 'festet' ELSE '' END AS plot_ownership, CASE WHEN k % 9 = 0 THEN '' WHEN k % 2 = 0 THEN 'Leilighet' ELSE 'Ene bolig' END AS kind, CASE WHEN k % 12 <> 0 THEN cast(1900 + k % 120 AS VARCHAR) ELSE '' END AS year FROM o")
def listing_fields(spark, d) -> DataFrame:
    """The 18 fields of every page."""
    return P.listing_fields(bound(spark, d, "listing_pages"))


@query("WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT cast(k AS VARCHAR) AS id, cast(k % 6 AS INT) AS bedrooms, cast(k % 9 AS INT) AS rooms, CASE WHEN k % 4 <> 0 THEN cast(k % 13 AS INT) END AS floor,"
    " CASE k % 3 WHEN 1 THEN 'Selveier' WHEN 2 THEN 'Andel' ELSE 'Aksje' END AS eieform, CASE WHEN k % 5 <> 2 THEN 'Nabolag ' || c % 50 END AS nabolag,"
    + ", ".join(f" CASE WHEN k % {i + 3} <> 0 THEN (k % 500 + {i}) * 1000 END AS {name}" for i, name in enumerate(P.MONEY.values()))
    + ", CASE k % 6 WHEN 1 THEN 'A' WHEN 2 THEN 'E' WHEN 3 THEN 'C' WHEN 4 THEN 'E' END AS energimerke, CASE k % 6 WHEN 1 THEN 'Mørkegrønn' WHEN 2 THEN 'Oransje' END AS energifarge,"
    + ", ".join(f" CASE WHEN k % 7 <> 4 AND k % {i + 2} <> 0 THEN cast(k % 1000 + {i} AS VARCHAR) END AS {name}" for i, name in enumerate(P.REGISTRY.values()))
    + ", CASE WHEN k % 7 <> 3 THEN ['Balkong', 'Heis', 'Nr & ' || c % 7] ELSE [] END AS facilities FROM o")
def detail_fields(spark, d) -> DataFrame:
    """The 23 detail fields of every page, and its facilities."""
    return P.detail_fields(bound(spark, d, "listing_pages"))
