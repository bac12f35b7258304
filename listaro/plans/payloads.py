"""Queries over the whole nested payload, and over a corpus of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import aggregates as A
from listaro.operators import filters as O
from listaro.operators import joins as J
from listaro.operators import payload as Y
from listaro.plans import nightly, reading
from listaro.plans.bindings import BINDINGS, as_of, bound, cte
from listaro.sources import pages as G
from listaro.staging import read_table
from listaro.streaming.replay import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


BINDINGS["details"] = (
    "orders",
    [
        "cast(o_orderkey as string) AS id", "cast(o_orderkey % 8 as int) AS rom", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey % 12 as int) END AS etasje", "'Nabolag ' || cast(o_custkey % 40 as string) AS nabolag",
        "CASE o_orderkey % 5 WHEN 0 THEN 'Oransje' WHEN 1 THEN 'Grønn' END AS energifarge", "o_orderkey % 90000 AS omkostninger", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 % 700000 END AS fellesgjeld",
        "o_orderkey * 3 % 50000 AS fellesformue", "o_orderkey * 7 % 900000 AS formuesverdi", "CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey * 11 % 5000000 END AS verditakst", "CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 6000 END AS eiendomsskatt_kr",
    ],
    "o_orderkey % 10 <> 3",
)
BINDINGS["prose_facts"] = (
    "orders",
    [
        "cast(o_orderkey as string) AS id", "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS boligselgerforsikring", "CASE o_orderkey % 4 WHEN 0 THEN 'ferdigattest' WHEN 1 THEN 'ingen' END AS ferdigattest",
        "o_orderkey % 7 = 0 AS radon_omtalt", "CASE WHEN o_orderkey % 5 = 0 THEN 'tillatt' END AS utleie", "CASE WHEN o_orderkey % 6 = 0 THEN 'ikke_tillatt' END AS husdyr", "o_orderkey % 8 = 0 AS heftelser", "9000 + o_orderkey % 10 AS eiendomsskatt_kr",
    ],
    "o_orderkey % 10 <> 7",
)


def _payload(spark, d) -> DataFrame:
    geo = J.resolve_donor(bound(spark, d, "geo")).select("id", "lat", "lng", "brj", "mvv")
    base = Y.listing_base(bound(spark, d, "listings"), geo, bound(spark, d, "details"), bound(spark, d, "prose_facts"), A.rollup_findings(bound(spark, d, "findings")))
    return Y.full_payload(base, bound(spark, d, "facilities"), bound(spark, d, "findings"), bound(spark, d, "sold"), bound(spark, d, "listings_b"), as_of())


_KEYS = ("id", "adresse", "postnummer", "pris", "pris_kvm", "boligtype", "tilgjengelighet", "lat", "lng", "brj", "mvv", "bra_i", "byggeaar", "url", "image", "scraped_at", "source", "sold", "closed", *Y.DETAILS, "pris_kvm_totalpris", "maanedskost", "eiendomsskatt_kr", *Y.PROSE, *Y.ROLLUP, "facilities", "findings", "bucket")
_B_KEYS = {"id": "'b:' || substr(sha1(coalesce(url, '')), 1, 16)", "adresse": "adresse", "postnummer": "CASE WHEN regexp_matches(postnummer, '^[0-9]') THEN lpad(split_part(postnummer, '.', 1), 4, '0') ELSE postnummer END", "pris": "pris", "boligtype": "boligtype", "lat": "lat", "lng": "lng", "url": "url", "image": "false", "source": "'b'", "sold": "false", "closed": "false", "facilities": "[]::VARCHAR[]", "bucket": "'b'"}
_SOURCE = {"pris_kvm": "v.pris_kvm", "brj": "g.brj", "mvv": "g.mvv", "image": "coalesce(trim(l.image_url), '') <> ''", "source": "'a'", "pris_kvm_totalpris": "dc.total_kvm", "maanedskost": "dc.monthly", "eiendomsskatt_kr": "coalesce(dt.eiendomsskatt_kr, pr.eiendomsskatt_kr)", "facilities": "coalesce(ch.facilities, [])", "findings": "ch.findings"}
_SOURCE |= {"pris_kvm": "CASE WHEN coalesce(bra_primary, l.bra_i, bra_total) > 0 THEN cast(round_even(l.pris::DOUBLE / coalesce(bra_primary, l.bra_i, bra_total)::DOUBLE, 0) AS BIGINT) END"}
_SOURCE |= {k: f"ro.{c}" for k, c in Y.ROLLUP.items()} | {c: f"g.{c}" for c in ("lat", "lng")} | {c: f"pr.{c}" for c in Y.PROSE} | {c: f"dt.{c}" for c in ("rom", "etasje", "nabolag", "energifarge", "omkostninger", "fellesgjeld", "fellesformue", "formuesverdi", "verditakst")}
_ACTIVE = {"tilgjengelighet": "l.status", "sold": "false", "closed": "false", "bucket": "'active'"}
_CLOSED = {"tilgjengelighet": "vc.shown_status", "sold": "coalesce(vc.shown_status = 'Solgt', false)", "closed": "vc.shown_status IS NOT NULL", "bucket": "'closed'"}


def _bucket(own: dict[str, str], visible: str) -> str:
    chosen = _SOURCE | own
    return f"SELECT {', '.join(f'{chosen.get(k, 'l.' + k)} AS {k}' for k in _KEYS)} FROM listings l JOIN {visible} USING (id) LEFT JOIN gr g USING (id) LEFT JOIN details dt USING (id) LEFT JOIN prose_facts pr USING (id) LEFT JOIN ro USING (id) LEFT JOIN ch USING (id) LEFT JOIN dc USING (id)"


_PAYLOAD = (
    cte("listings", "geo", "details", "prose_facts", "listings_b")
    + f", va AS ({reading.SQL['visible_active']}), vc AS ({reading.SQL['visible_closed']}), ro AS ({nightly.SQL['rollup_findings']}), ch AS ({reading.SQL['with_children']}), dc AS ({reading.SQL['derived_costs']}), vb AS ({reading.SQL['visible_source_b']}),"
    + " gr AS (SELECT g.id, g.lat, g.lng, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.brj IS NOT NULL THEN s.brj ELSE g.brj END AS brj, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.mvv IS NOT NULL THEN s.mvv ELSE g.mvv END AS mvv FROM geo g LEFT JOIN geo s ON s.id = g.donor),"
    + f" payload AS ({_bucket(_ACTIVE, 'va')} UNION ALL {_bucket(_CLOSED, 'vc')} UNION ALL SELECT {', '.join(f'{_B_KEYS.get(k, 'NULL')} AS {k}' for k in _KEYS)} FROM listings_b WHERE b_id IN (SELECT b_id FROM vb))"
)


def _flat(rows: DataFrame) -> DataFrame:
    """The travel map's entries as columns."""
    return rows.select(*[F.col("travel")[c].alias(c) if c in ("brj", "mvv") else F.col(c) for c in _KEYS])


@query(_PAYLOAD + " SELECT * FROM payload")
def full_payload(spark, d) -> DataFrame:
    """Every key of all three buckets."""
    return _flat(_payload(spark, d))


_WANTED = ["1", "7", "32", "100", "2499", "3001", "no such id"]


@query(_PAYLOAD + f" SELECT * FROM payload WHERE id IN ({', '.join(repr(x) for x in _WANTED)}) OR id = 'b:' || substr(sha1('https://B.example/Homes/3'), 1, 16)")
def payload_detail(spark, d) -> DataFrame:
    """Single listings of either source, looked up in the written payload."""
    import hashlib

    path = new_folder(spark, "payload")
    Y.write_payload(_payload(spark, d), path)
    return _flat(Y.detail(spark, path, [*_WANTED, "b:" + hashlib.sha1(b"https://B.example/Homes/3").hexdigest()[:16]]))


# The whole selection


_BOUNDS = {
    "at_most": {"pris": 5_500_000, "totalpris": 6_500_000, "felleskost_mnd": 5200, "pris_kvm_totalpris": 80_000, "maanedskost": 6300, "pris_kvm": 75_000, "reparasjon_est": 420_000}, "at_least": {"bra_i": 45, "soverom": 1, "byggeaar": 1925},
    "travel_max": {"brj": 95, "mvv": 99},
    "selected": {
        "boligtype": ("", "1-URGENT", "2-HIGH", "3-MEDIUM", "BUILDING"), "tag": ("",), "tilgjengelighet": ("", "Solgt", "Inaktiv"), "energimerke": ("", "A", "C"), "alvorlighet": ("", "mindre", "vesentlig", "alvorlig"),
        "ferdigattest": ("", "ferdigattest"), "utleie": ("", "tillatt"), "husdyr": ("",),
    },
    "selected_sets": {"eieform": ("Eier", "Andel")}, "facilities": ("heis",), "sold_at_most": {"sold_price": 5_600_000, "premium": 2.4},
}


def _shown_sql(include_unknown: bool) -> str:
    """The selection as SQL: what is unknown fails a bound only if it is not included, is the value "" of a selection, and never fails a travel time."""
    lost = "false" if include_unknown else "true"
    tests = [f"CASE WHEN {c} IS NULL THEN {lost} ELSE {c} > {v} END" for c, v in _BOUNDS["at_most"].items()] + [f"CASE WHEN {c} IS NULL THEN {lost} ELSE {c} < {v} END" for c, v in _BOUNDS["at_least"].items()]
    tests += [f"coalesce(CASE WHEN {c} < 0 THEN 999 ELSE {c} END > {v}, false)" for c, v in _BOUNDS["travel_max"].items()]
    tests += [f"coalesce({c}, '') NOT IN ({', '.join(repr(x) for x in v)})" for c, v in _BOUNDS["selected"].items()]
    tests += [f"CASE WHEN coalesce({c}, '') = '' THEN {lost} ELSE {c} NOT IN ({', '.join(repr(x) for x in v)}) END" for c, v in _BOUNDS["selected_sets"].items()]
    tests += [f"sold AND CASE WHEN {c} IS NULL THEN {lost} ELSE {c} > {v} END" for c, v in _BOUNDS["sold_at_most"].items()]
    tests += [f"CASE WHEN len(coalesce(facilities, [])) = 0 THEN {lost} ELSE NOT list_has_all(facilities, {list(_BOUNDS['facilities'])}) END"]
    return " AND ".join(f"NOT ({t})" for t in tests)


@query(_PAYLOAD.replace("WITH ", cte("sold") + ", ", 1) + f""", i AS (SELECT payload.*, NULL::VARCHAR AS tag, sold.sold_price, CASE WHEN sold.price_suggestion > 0 THEN (sold.sold_price - sold.price_suggestion) / sold.price_suggestion::DOUBLE * 100.0 END AS premium FROM payload LEFT JOIN sold USING (id))
SELECT id, bucket, {_shown_sql(True)} AS shown, {_shown_sql(False)} AS shown_if_known FROM i
""")
def payload_predicate(spark, d) -> DataFrame:
    """Twelve bounds, travel times, eight selections, sets and facilities over the payload, with what is unknown and without."""
    sales = bound(spark, d, "sold").select("id", "sold_price", S.premium_pct("sold_price", "price_suggestion").alias("premium"))
    rows = _flat(_payload(spark, d)).withColumn("tag", F.lit(None).cast("string")).join(sales, "id", "left")
    shown = [~O.listing_excluded(O.Filters(**_BOUNDS, include_unknown=x)) for x in (True, False)]
    return rows.select("id", "bucket", shown[0].alias("shown"), shown[1].alias("shown_if_known"))


# A corpus of landed files


@query("""
SELECT count(*) AS wanted, count(*) FILTER (doc_id % 10 = 0) AS missing, count(*) FILTER (doc_id % 10 = 1 OR (doc_id % 10 > 2 AND trim(coalesce(text, ''), E' \\n\\t\\r') = '')) AS blank, count(*) FILTER (doc_id % 10 = 2) AS unreadable FROM documents
""")
def corpus_scan(spark, d) -> DataFrame:
    """Documents landed as pages: every tenth is missing, another one blank, another one no text."""
    docs = read_table(spark, f"{d}/documents.parquet")
    digit = F.col("doc_id") % 10
    content = F.when(digit == 1, F.lit(" \n").cast("binary")).when(digit == 2, F.unhex(F.lit("FFFE00C3"))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    landed = docs.filter(digit != 0).select(F.concat(F.lit("landed/"), "doc_id", F.lit(".html")).alias("path"), content.alias("content"))
    return G.scan_report(docs.select(F.col("doc_id").cast("string").alias("id")), G.read_pages(landed))
