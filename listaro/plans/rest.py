"""Queries over parsed pages, chains of donors, corrections, caches, gates and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import aggregates as A
from listaro.operators import control as C
from listaro.operators import filters as O
from listaro.operators import joins as J
from listaro.operators import facts as T
from listaro.operators import parsing as P
from listaro.operators import places as L
from listaro.operators import publish as B
from listaro.plans.bindings import AS_OF_SQL, BINDINGS, as_of, bound, cte
from listaro.plans.documents import _LINES
from listaro.plans.nightly import _DIST
from listaro.plans.nightly import SQL as NIGHTLY_SQL
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


_OWN = "CASE c_custkey % 4 WHEN 0 THEN 'FREEHOLD' WHEN 1 THEN 'PART_OWNERSHIP' WHEN 2 THEN 'STOCK' ELSE 'OTHER' END"
_SHOWN = "CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Eier (Selveier)' ELSE 'Andel' END ELSE '' END"
_LABEL = "CASE c_custkey % 5 WHEN 0 THEN ' A - Mørkegrønn' WHEN 1 THEN ' - Oransje' WHEN 2 THEN ' C' ELSE '' END"
_BADGE = "CASE WHEN c_custkey % 5 IN (1, 3) THEN 'Energimerke E' WHEN c_custkey % 5 = 4 THEN 'Energimerke' ELSE '' END"

#: Pages and lists built from customers, as the sources land them.
BINDINGS |= {
    "ad_pages": (
        "customer",
        [
            "cast(c_custkey as string) AS id",
            "'<html><script id=\"advertising-initial-state\" type=\"application/json\">' || CASE WHEN c_custkey % 17 = 0 THEN '{broken' ELSE '{\"config\":{\"adServer\":{\"gam\":{\"targeting\":[{\"key\":\"ownership_type\",\"value\":[\"' || " + _OWN + " || '\"]},{\"key\":\"bare\"},{\"key\":\"rooms\",\"value\":[\"' || cast(c_custkey % 9 as string) || '\",\"x\"]}]}}}}' END || '</script>"
            "<div data-testid=\"info-ownership-type\"><dd>' || " + _SHOWN + " || '</dd></div><div data-testid=\"energy-label\">Energimerking' || " + _LABEL + " || '<svg aria-label=\"' || " + _BADGE + " || '\"></svg></div>"
            "<dl data-testid=\"pricing-details\"><dt>Totalpris</dt><dd>' || cast(c_custkey as string) || ' 500 kr</dd><dt>Fellesgjeld</dt><dd>' || CASE WHEN c_custkey % 6 = 0 THEN 'ukjent' ELSE cast(c_nationkey as string) || ' kr' END || '</dd><dt>Annet</dt><dd>1 kr</dd></dl>"
            "<section data-testid=\"object-facilities\"><div>Balkong</div><div> Heis </div><div>Balkong</div><div>' || c_mktsegment || '</div></section></html>' AS html",
        ],
        None,
    ),
    "state_pages": (
        "customer",
        [
            "cast(c_custkey as string) AS id",
            "'<script id=\"state\">' || CASE c_custkey % 4 WHEN 0 THEN '{\"state\":{\"ad\":{\"name\":\"' || c_name || '\",\"size\":' || cast(c_nationkey as string) || ',\"sold\":true}}}' "
            "WHEN 1 THEN '[{\"_1\":2},\"ad\",{\"_3\":4,\"_5\":6,\"_7\":-7,\"_8\":0},\"name\",\"' || c_name || '\",\"size\",' || cast(c_nationkey as string) || ',\"sold\",\"self\"]' "
            "WHEN 2 THEN '{\"ad\":{\"name\":\"' || c_name || '\",\"sold\":false}}' ELSE 'no json' END || '</script>' AS html",
        ],
        None,
    ),
    "b_pages": (
        "customer",
        [
            "cast(c_custkey as string) AS id",
            "'<script type=\"application/ld+json\">{\"@type\":\"Organization\",\"name\":\"x\"}</script><script type=\"application/ld+json\">' || CASE c_custkey % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '[' WHEN 2 THEN '{\"@type\":\"ItemList\",\"itemListElement\":[{\"item\":{\"@type\":\"Other\"}},{\"item\":' ELSE '' END || "
            "'{\"@type\":\"RealEstateListing\",' || CASE WHEN c_custkey % 3 = 0 THEN '\"@id\"' ELSE '\"url\"' END || ':\"u' || cast(c_custkey as string) || '\",\"name\":\"' || c_name || '\",\"about\":{\"@type\":\"' || CASE c_custkey % 3 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'House' ELSE 'Castle' END || '\",\"address\":{\"postalCode\":\"' || cast(c_custkey % 9999 as string) || '\"}},"
            "\"offers\":{\"priceSpecification\":[{\"name\":\"Omkostninger\",\"price\":7},{\"name\":\"' || CASE WHEN c_custkey % 2 = 0 THEN 'Prisantydning' ELSE 'Annet' END || '\",\"price\":' || cast(c_custkey as string) || '}]}}' || CASE c_custkey % 5 WHEN 1 THEN ']' WHEN 2 THEN '}]}' ELSE '' END || '</script>' AS html",
        ],
        None,
    ),
    "card_bodies": (
        "customer",
        ["CASE WHEN c_custkey % 13 = 0 THEN '<html>' ELSE '{\"docs\":[{\"adId\":' || cast(c_custkey as string) || ',\"cadastralSoldPrice\":' || cast(c_custkey * 100 as string) || ',\"soldDate\":\"2020-01-02\",\"size\":' || cast(c_nationkey as string) || '},{\"address\":\"no key\"}]}' END AS body"],
        None,
    ),
    # Blocks of seven customers: a chain each, but every tenth block a cycle that the block before it leads into.
    "chain": (
        "customer",
        [
            "cast(c_custkey as string) AS id",
            "CASE WHEN c_custkey % 7 <> 1 THEN cast(c_custkey - 1 as string) WHEN ((c_custkey - 1) {div} 7) % 10 = 3 THEN cast(c_custkey + 6 as string) WHEN ((c_custkey - 1) {div} 7) % 10 = 4 THEN cast(c_custkey - 3 as string) END AS target",
            "CASE WHEN c_custkey % 11 = 0 THEN -1 WHEN c_custkey % 5 = 0 THEN cast(c_custkey % 90 as int) END AS value",
        ],
        None,
    ),
}


# Parsed pages


@query(f"SELECT cast(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 2 END AS keys, CASE WHEN c_custkey % 17 <> 0 THEN {_OWN} END AS code, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey % 9 END AS rooms FROM customer")
def targeting_maps(spark, d) -> DataFrame:
    rows = bound(spark, d, "ad_pages").select("id", P.targeting_map(F.col("html")).alias("t"))
    return rows.select("id", F.size("t").alias("keys"), F.get(F.col("t")["ownership_type"], F.lit(0)).alias("code"), F.get(F.col("t")["rooms"], F.lit(0)).try_cast("long").alias("rooms"))


@query("""
SELECT cast(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS name, CASE WHEN c_custkey % 4 < 2 THEN c_nationkey::BIGINT END AS size,
  CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' END AS sold FROM customer
""")
def app_states(spark, d) -> DataFrame:
    """Both wire formats of the app state, a cycle among them."""
    rows = P.decode_app_state(bound(spark, d, "state_pages"), "state", ["id"])
    def at(path):
        return F.get_json_object("state", f"$.ad.{path}")
    return rows.select("id", at("name").alias("name"), at("size").try_cast("long").alias("size"), at("sold").alias("sold"))


@query(f"""
SELECT cast(c_custkey AS VARCHAR) AS id, CASE WHEN {_SHOWN} = 'Eier (Selveier)' THEN 'Selveier' WHEN {_SHOWN} <> '' THEN {_SHOWN} WHEN c_custkey % 17 = 0 THEN NULL ELSE CASE {_OWN} WHEN 'FREEHOLD' THEN 'Selveier' WHEN 'PART_OWNERSHIP' THEN 'Andel' WHEN 'STOCK' THEN 'Aksje' ELSE 'OTHER' END END AS eieform,
  CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'E' WHEN 2 THEN 'C' WHEN 3 THEN 'E' END AS energimerke, CASE c_custkey % 5 WHEN 0 THEN 'Mørkegrønn' WHEN 1 THEN 'Oransje' END AS energifarge,
  c_custkey * 1000 + 500 AS totalpris, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey::BIGINT END AS fellesgjeld, ['Balkong', 'Heis', c_mktsegment] AS facilities FROM customer
""")
def page_details(spark, d) -> DataFrame:
    """Some detail fields of a page: ownership, energy grade and colour, money by its labels, facilities."""
    return P.detail_fields(bound(spark, d, "ad_pages")).select("id", "eieform", "energimerke", "energifarge", "totalpris", "fellesgjeld", "facilities")


@query("""
SELECT cast(c_custkey AS VARCHAR) AS id, 'u' || cast(c_custkey AS VARCHAR) AS url, c_name AS title, cast(c_custkey % 9999 AS VARCHAR) AS postcode, CASE c_custkey % 3 WHEN 0 THEN 'Leilighet' WHEN 1 THEN 'Enebolig' ELSE 'Castle' END AS kind,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 7 END::BIGINT AS price FROM customer WHERE c_custkey % 5 <> 0
""")
def structured_listings(spark, d) -> DataFrame:
    """Listings of the second source from their structured data, also in lists and item lists."""
    found = bound(spark, d, "b_pages").select("id", P.jsonld_entry(F.col("html")).alias("e")).filter("e is not null")
    return found.select("id", *P.project_jsonld(F.col("e"))).select("id", "url", "title", "postcode", "kind", "price")


@query("SELECT cast(c_custkey AS VARCHAR) AS id, c_custkey * 100 AS sold_price, '2020-01-02' AS sold_date, c_nationkey::INTEGER AS size FROM customer WHERE c_custkey % 13 <> 0")
def sale_cards(spark, d) -> DataFrame:
    return P.sale_cards(bound(spark, d, "card_bodies")).select("id", "sold_price", "sold_date", "size")


@query("SELECT cast(c_custkey AS VARCHAR) AS id, c_mktsegment AS comment, NULL::VARCHAR AS tag FROM customer WHERE c_custkey % 19 <> 0")
def annotation_rows(spark, d) -> DataFrame:
    """A hand-edited tab with headers of any case, link formulas and empty ids."""
    tab = read_table(spark, f"{d}/customer.parquet").selectExpr(
        "CASE WHEN c_custkey % 19 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN '=HYPERLINK(\"https://x/9\", \"' || c_custkey || '\")' ELSE ' ' || c_custkey || ' ' END AS ` ID `", "c_mktsegment AS COMMENT", "c_name AS other"
    )
    return P.annotation_tab(tab, {"id": "id", "comment": "comment", "tag": "tag"})


_PROSE = "CASE doc_id % 6 WHEN 0 THEN ' Det er egen utleiedel. ' WHEN 1 THEN ' Det er ikke tillatt med utleie. Dyrehold er tillatt. ' WHEN 2 THEN ' Boligen kan leies ut. Husdyr ikke tillatt uten styrets samtykke. ' WHEN 3 THEN ' Forbud mot husdyr. ' ELSE ' ' END"


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'egen_enhet' WHEN 1 THEN 'ikke_tillatt' WHEN 2 THEN 'tillatt' END AS rental,
  CASE doc_id % 6 WHEN 1 THEN 'tillatt' WHEN 2 THEN 'krever_godkjenning' WHEN 3 THEN 'ikke_tillatt' END AS pets FROM documents
""")
def prose_rules(spark, d) -> DataFrame:
    """Rental and pet rules of the documents, each followed by a listing's sentences; expected is what a reader takes from those. They stand on a line of their own, as not every document ends its last sentence."""
    rows = read_table(spark, f"{d}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_PROSE)).alias("x"))
    return rows.select("doc_id", T.rental(F.col("x")).alias("rental"), T.pets(F.col("x")).alias("pets"))


_PAPERS = "CASE doc_id % 9 WHEN 0 THEN ' Det foreligger ikke ferdigattest, men midlertidig brukstillatelse. ' WHEN 1 THEN ' Ferdigattest er utstedt 2001. ' WHEN 2 THEN ' Det er ikke mottatt Ferdigattest. ' WHEN 3 THEN ' Se punktet ferdigattest/midlertidig brukstillatelse for mer. ' WHEN 4 THEN ' Midlertidig brukstillatelse av 1999. ' WHEN 5 THEN ' At ferdigattest eksisterer, gir ingen garanti for annet. ' WHEN 6 THEN ' Ferdigattesten omfatter ikke boden. ' ELSE ' ' END"


@query("""
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'midlertidig' WHEN 1 THEN 'ferdigattest' WHEN 2 THEN 'ingen' WHEN 3 THEN 'ferdigattest' WHEN 4 THEN 'midlertidig' WHEN 5 THEN 'ferdigattest' WHEN 6 THEN 'ferdigattest' END AS certificate FROM documents
""")
def certificates(spark, d) -> DataFrame:
    """What the documents, each followed by a listing's sentence, say of a completion certificate; expected is what a reader takes from it. It stands on a line of its own, as not every document ends its last sentence."""
    rows = read_table(spark, f"{d}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_PAPERS)).alias("x"))
    return rows.select("doc_id", T.certificate(F.col("x")).alias("certificate"))


# Chains


_WALK = cte("chain") + """, walk AS (
  WITH RECURSIVE w AS (SELECT id, id AS node, 0 AS step FROM chain UNION ALL SELECT w.id, c.target, step + 1 FROM w JOIN chain c ON c.id = w.node WHERE c.target IS NOT NULL AND step < 40 AND EXISTS (SELECT 1 FROM chain e WHERE e.id = c.target))
  SELECT * FROM w)
"""


@query(_WALK + """, last AS (SELECT id, max(step) AS steps FROM walk GROUP BY id), ends AS (SELECT walk.id, node FROM walk JOIN last ON walk.id = last.id AND step = steps WHERE steps < 40),
cycles AS (SELECT id, min(node) AS low FROM walk WHERE step BETWEEN 20 AND 40 AND id NOT IN (SELECT id FROM ends) GROUP BY id)
SELECT c.id, coalesce(CASE WHEN t.target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chain e WHERE e.id = t.target) THEN t.target ELSE ends.node END, low) AS root FROM chain c LEFT JOIN ends ON ends.id = c.id LEFT JOIN cycles ON cycles.id = c.id LEFT JOIN chain t ON t.id = ends.node WHERE c.target IS NOT NULL
""")
def long_chain_roots(spark, d) -> DataFrame:
    """Roots of chains of one to seven pointers, of cycles and of chains that lead into them."""
    return J.chain_roots(bound(spark, d, "chain").filter("target is not null").select("id", "target"))


@query(_WALK + ", v AS (SELECT walk.id, arg_min(c.value, step) AS value FROM walk JOIN chain c ON c.id = walk.node WHERE c.value IS NOT NULL GROUP BY walk.id) SELECT chain.id, v.value FROM chain LEFT JOIN v ON v.id = chain.id")
def chain_values(spark, d) -> DataFrame:
    """What each row takes over along its pointers, its own value first; failure codes count as values."""
    return J.chain_value(bound(spark, d, "chain"))


@query(_WALK + ", v AS (SELECT walk.id, arg_min(c.value, step) AS value FROM walk JOIN chain c ON c.id = walk.node WHERE c.value IS NOT NULL GROUP BY walk.id) SELECT count(*) - count(v.value) AS calls, count(v.value) FILTER (chain.value IS NULL) AS reused FROM chain LEFT JOIN v ON v.id = chain.id")
def estimate_chain(spark, d) -> DataFrame:
    """Calls that are needed if a pointer is reused only where its chain has a value."""
    rows = bound(spark, d, "chain")
    found = J.chain_value(rows).withColumnRenamed("value", "resolved").join(rows.select("id", "value"), "id")
    return found.agg(F.count_if(F.col("resolved").isNull()).alias("calls"), F.count_if(F.col("resolved").isNotNull() & F.col("value").isNull()).alias("reused"))


@query(cte("geo") + ", r AS (SELECT id, brj, CASE WHEN trim(coalesce(donor, '')) <> '' THEN donor ELSE id END AS root FROM geo WHERE brj IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id <> root, id) AS k FROM r) SELECT root, id, brj FROM n WHERE k = 1")
def one_per_root(spark, d) -> DataFrame:
    """One row with a value of each donor root, the root's own if it has one."""
    geo = bound(spark, d, "geo")
    roots = J.chain_roots(geo.filter(F.coalesce(F.trim("donor"), F.lit("")) != "").select("id", F.col("donor").alias("target")))
    return J.one_per_root(geo.filter("brj is not null").select("id", "brj"), roots).select("root", "id", "brj")


@query(cte("listings") + ", a AS (SELECT id, 'active' AS pool FROM listings WHERE active), b AS (SELECT id, 'priced' AS pool FROM listings WHERE pris > 4000000) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def candidate_pools(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings")
    return J.first_pool(rows.filter("active").select("id", F.lit("active").alias("pool")), rows.filter("pris > 4000000").select("id", F.lit("priced").alias("pool")))


# Gates, caches, corrections


@query("SELECT event_type AS source, count(*) AS crawled, count(*) FILTER (event_id % CASE WHEN event_type = 'click' THEN 3 ELSE 17 END = 0) AS failed, CASE WHEN count(*) FILTER (event_id % CASE WHEN event_type = 'click' THEN 3 ELSE 17 END = 0)::DOUBLE / count(*) > 0.2::DOUBLE THEN 'too many failures' ELSE 'ok' END AS verdict FROM events GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 'no pages'")
def ingest_gate(spark, d) -> DataFrame:
    """Whether a crawl may switch off what it has not seen; one source was crawled without a page."""
    rows = read_table(spark, f"{d}/events.parquet").select(F.col("event_type").alias("source"), F.expr("event_id % CASE WHEN event_type = 'click' THEN 3 ELSE 17 END != 0").alias("ok"))
    empty = rows.limit(1).select(F.lit("none").alias("source"), F.lit(None).cast("boolean").alias("ok"))
    return C.ingest_gate(rows.unionByName(empty), "source")


@query("""
WITH t AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS doc FROM documents)
SELECT count(*) FILTER (doc % 2 = 0 AND doc % 3 <> 0) AS imported, count(*) FILTER (doc % 6 = 0) AS replaced, count(*) FILTER (doc % 3 = 0 OR doc % 2 = 0) AS size, count(*) FILTER (doc % 2 = 0) AS of_version_1 FROM t
""")
def import_cache(spark, d) -> DataFrame:
    """A cache of classified texts takes in another one, whose optional columns have defaults; its rows win."""
    docs = read_table(spark, f"{d}/documents.parquet").groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc"))
    cache = docs.filter("doc % 3 = 0").select("sha", F.lit("old").alias("response"), F.lit(0).alias("version"))
    merged, counts = C.import_cache(cache, docs.filter("doc % 2 = 0").select("sha", F.lit("new").alias("response")), defaults={"version": 1})
    return counts.join(merged.agg(F.count("*").alias("size"), F.count_if(F.col("version") == 1).alias("of_version_1")), F.lit(True))


@query(cte("listings") + ", o AS (SELECT id, CASE WHEN cast(id AS BIGINT) % 4 = 0 THEN 1 END AS pris, CASE WHEN cast(id AS BIGINT) % 3 = 0 THEN 'Ny vei 1' ELSE '' END AS adresse, '' AS postnummer FROM listings WHERE cast(id AS BIGINT) % 2 = 0) SELECT l.id, coalesce(o.pris, l.pris) AS pris, coalesce(nullif(o.adresse, ''), l.adresse) AS adresse, coalesce(nullif(o.postnummer, ''), l.postnummer) AS postnummer FROM listings l LEFT JOIN o USING (id)")
def apply_overrides(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings").select("id", "pris", "adresse", "postnummer")
    k = F.col("id").cast("long")
    manual = rows.filter(k % 2 == 0).select("id", F.when(k % 4 == 0, F.lit(1).cast("long")).alias("pris"), F.when(k % 3 == 0, "Ny vei 1").otherwise("").alias("adresse"), F.lit("").alias("postnummer"))
    return C.apply_overrides(rows, manual)


@query(cte("geo") + ", f AS (SELECT id, cast(id AS BIGINT) % 3 AS k FROM geo WHERE cast(id AS BIGINT) % 2 = 0) SELECT g.id, CASE f.k WHEN 0 THEN 60.5::DOUBLE WHEN 1 THEN 61.5::DOUBLE ELSE lat END AS lat, CASE f.k WHEN 0 THEN 10.5::DOUBLE WHEN 1 THEN 11.5::DOUBLE ELSE lng END AS lng, CASE WHEN f.k < 2 THEN 0 WHEN f.k = 2 THEN 1 ELSE geocode_failed END::INTEGER AS geocode_failed FROM geo g LEFT JOIN f USING (id)")
def apply_geocodes(spark, d) -> DataFrame:
    """New places: plausible, swapped, and neither."""
    geo = bound(spark, d, "geo").select("id", "lat", "lng", "geocode_failed")
    k = F.col("id").cast("long") % 3
    found = geo.filter("cast(id as bigint) % 2 = 0").select("id", F.when(k == 0, 60.5).when(k == 1, 11.5).otherwise(0.0).alias("lat"), F.when(k == 0, 10.5).when(k == 1, 61.5).otherwise(0.0).alias("lng"))
    return C.apply_geocodes(geo, found)


@query(cte("listings") + "SELECT id, CASE WHEN coalesce(bra_primary, bra_i, bra_total) > 0 THEN cast(round_even(pris::DOUBLE / coalesce(bra_primary, bra_i, bra_total)::DOUBLE, 0) AS BIGINT) END AS pris_kvm FROM listings WHERE CASE WHEN coalesce(bra_primary, bra_i, bra_total) > 0 THEN cast(round_even(pris::DOUBLE / coalesce(bra_primary, bra_i, bra_total)::DOUBLE, 0) AS BIGINT) END IS DISTINCT FROM cast(pris // 80 AS BIGINT)")
def refresh_derived(spark, d) -> DataFrame:
    """Prices per square metre that differ from those held."""
    rows = bound(spark, d, "listings")
    held = rows.select("id", F.expr("pris div 80").alias("pris_kvm"))
    return C.refresh_derived(held, rows.select("id", S.price_per_m2("pris", "bra_primary", "bra_i", "bra_total").alias("pris_kvm")), ["pris_kvm"])


@query(cte("listings") + ", v AS (SELECT DISTINCT boligtype AS value FROM listings WHERE boligtype IS NOT NULL), s AS (SELECT * FROM (VALUES ('1-URGENT'), ('3-MEDIUM'), ('Slott')) t(value)) SELECT 'boligtype' AS field, value, true AS complete FROM s WHERE value IN (SELECT value FROM v) UNION ALL SELECT 'boligtype', value, false FROM s")
def prune_selection(spark, d) -> DataFrame:
    """Selected types that are left once the vocabulary is known in full, and before."""
    vocabulary = bound(spark, d, "listings").filter("boligtype is not null").select(F.lit("boligtype").alias("field"), F.col("boligtype").alias("value")).distinct()
    chosen = spark.createDataFrame([("boligtype", x) for x in ("1-URGENT", "3-MEDIUM", "Slott")], "field string, value string")
    parts = [C.prune_selection(chosen, vocabulary, c).withColumn("complete", F.lit(c)) for c in (True, False)]
    return parts[0].unionByName(parts[1])


@query(f"WITH {_LINES}, s AS (SELECT * FROM (VALUES (1, 'Nytt'), (900000, 'Nord'), (900001, 'Sør')) t(station_id, name)) SELECT s_suppkey::BIGINT AS station_id, s_name AS name FROM supplier WHERE s_suppkey % 50 <> 2 UNION ALL SELECT station_id::BIGINT, name FROM s WHERE station_id NOT IN (SELECT s_suppkey FROM supplier)")
def repair_stations(spark, d) -> DataFrame:
    """Missing stations are added if the line they belong to is there at all, and wrong ones taken out."""
    stations = bound(spark, d, "stations").select(F.col("station_id").cast("long").alias("station_id"), "name")
    seed = spark.createDataFrame([(1, "Nytt"), (900000, "Nord"), (900001, "Sør")], "station_id long, name string")
    return C.repair_rows(stations, stations.filter("station_id = 3").select("station_id"), seed, stations.filter("station_id % 50 = 2").select("station_id"), "station_id")


_SCORED = NIGHTLY_SQL["score_outliers"].replace(" WHERE score >= 2", "")


@query(f"""
SELECT s.id, s.score + CASE WHEN f.reason IS NULL THEN 0 ELSE 3 END AS score, near_n, post_n, reason FROM ({_SCORED}) s LEFT JOIN (
  {cte("geo")} SELECT a.id, 'Donor: ' || cast(round_even({_DIST}, 0) AS BIGINT) || 'm > 300m (' || trim(a.donor) || ')' AS reason FROM geo a JOIN geo b ON b.id = trim(a.donor) WHERE {_DIST} > 300) f USING (id)
WHERE s.score + CASE WHEN f.reason IS NULL THEN 0 ELSE 3 END >= 3
""")
def outlier_findings(spark, d) -> DataFrame:
    """Outlier scores in full, the distance to the donor included, with the reason that it gives."""
    geo = bound(spark, d, "geo")
    rows = geo.select("id", F.col("brj").alias("value"), "lat", "lng").join(bound(spark, d, "listings").select("id", (F.col("postnummer").cast("long") % 40).cast("string").alias("postcode")), "id")
    donors = geo.select(F.col("id").alias("donor"), F.col("lat").alias("donor_lat"), F.col("lng").alias("donor_lng"))
    return A.with_donor_distance(A.score_outliers(rows, threshold=0), geo.select("id", "lat", "lng", F.trim("donor").alias("donor")), donors, 300.0)


_EMPTY = ", ".join(f"'' AS \"{h}\"" for h, c in B.SHEET.items() if c in (None, "comment", "tag"))


@query(cte("listings", "geo") + f"""
, r AS (SELECT l.*, g.lat, g.lng, g.donor, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.brj IS NOT NULL THEN s.brj ELSE g.brj END AS brj, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.mvv IS NOT NULL THEN s.mvv ELSE g.mvv END AS mvv
  FROM listings l LEFT JOIN geo g USING (id) LEFT JOIN geo s ON s.id = g.donor
  WHERE active AND lower(trim(coalesce(status, ''))) NOT IN ('solgt', 'inaktiv') AND pris <= 7500000 AND bra_i >= 40)
SELECT id AS "Finnkode", coalesce(trim(status), '') AS "Tilgjengelighet", 'true' AS "active", coalesce(trim(adresse), '') AS "ADRESSE", CASE WHEN postnummer IS NULL THEN '' ELSE lpad(postnummer, cast(greatest(4, length(postnummer)) AS INTEGER), '0') END AS "Postnummer",
  coalesce(pris, 0) AS "Pris", trim(url) AS "URL", coalesce(trim(image_url), '') AS "IMAGE_URL", coalesce(cast(bra_total AS VARCHAR), '') AS "Bruksareal", coalesce(cast(bra_i AS VARCHAR), '') AS "Internt bruksareal (BRA-i)", coalesce(cast(bra_primary AS VARCHAR), '') AS "Primærrom",
  coalesce(trim(eieform), '') AS "Eierskap, tomt", coalesce(trim(boligtype), '') AS "Boligtype", coalesce(cast(byggeaar AS VARCHAR), '') AS "Byggeår", coalesce(cast(cast(floor(lat * 1000) AS BIGINT) AS VARCHAR), '') AS "LAT", coalesce(cast(cast(floor(lng * 1000) AS BIGINT) AS VARCHAR), '') AS "LNG",
  coalesce(CASE WHEN coalesce(bra_primary, bra_i, bra_total) > 0 THEN cast(round_even(pris::DOUBLE / coalesce(bra_primary, bra_i, bra_total)::DOUBLE, 0) AS BIGINT) END, 0) AS "PRIS KVM",
  coalesce(cast(brj AS VARCHAR), '') AS "PENDL RUSH BRJ", coalesce(cast(mvv AS VARCHAR), '') AS "PENDL RUSH MVV", coalesce(trim(donor), '') AS "TRAVEL_COPY_FROM_FINNKODE",
  coalesce('https://www.google.com/maps/place/' || replace(trim(adresse) || '+' || trim(postnummer), ' ', '+'), '') AS "GOOGLE_MAPS_URL", strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS "SCRAPED_AT", {_EMPTY} FROM r
""")
def publish_sheet(spark, d) -> DataFrame:
    """The full sheet of visible active listings, places in thousandths of a degree."""
    geo = J.resolve_donor(bound(spark, d, "geo"))
    rows = O.visible_active(bound(spark, d, "listings")).drop("lat", "lng").join(geo.select("id", "brj", "mvv", *[F.floor(F.col(c) * 1000).cast("string").alias(c) for c in ("lat", "lng")], "donor"), "id", "left")
    rows = rows.withColumns({"pris_kvm": S.price_per_m2("pris", "bra_primary", "bra_i", "bra_total"), "maps_url": S.map_url("adresse", "postnummer"), "scraped_at": F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss")})
    return B.sheet(rows)


# Texts and small values


@query(f"SELECT s_suppkey AS station_id, CASE WHEN s_suppkey % 3 = 0 THEN 'UNASSIGNED' ELSE 'L' || cast(s_suppkey % 9 AS VARCHAR) END AS line, coalesce(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 400 + (s_suppkey % 5) * 300 END, 1000) AS reach, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 6 = 0 THEN NULL ELSE least(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 60 END, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 45 + 5 END) END AS minutes FROM supplier")
def station_values(spark, d) -> DataFrame:
    """Line ids, radii and best minutes, direct or with a change; an unknown way never beats a known one."""
    k = F.col("station_id")
    rows = bound(spark, d, "stations").select("station_id", "radius_m", F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" l"), (k % 9).cast("string"))).alias("line"), F.when(k % 4 != 0, k % 60).alias("direct"), F.when(k % 6 != 0, k % 45 + 5).alias("changed"))
    return rows.select("station_id", C.line_id(F.col("line")).alias("line"), F.coalesce("radius_m", F.lit(1000)).alias("reach"), F.least("direct", "changed").alias("minutes"))


@query(cte("observations") + "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN epoch(date_trunc('second', observed_at))::BIGINT - 3600 ELSE epoch(date_trunc('second', observed_at))::BIGINT END AS at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x-' || cast(event_id AS VARCHAR) END AS id FROM observations")
def parsed_times(spark, d) -> DataFrame:
    """Instants from texts in several forms, and ids with characters that are not allowed left out."""
    k = F.col("event_id") % 4
    t = F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss")
    text = F.when(k == 0, t).when(k == 1, F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z"))).when(k == 2, F.concat(t, F.lit("+01:00"))).otherwise(F.lit("yesterday"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("x-"), F.col("event_id").cast("string")))
    rows = bound(spark, d, "observations").select("event_id", text.alias("text"), raw.alias("raw"))
    return rows.select("event_id", F.unix_seconds(C.timestamp_utc(F.col("text"))).alias("at"), C.plain_id(F.col("raw")).alias("id"))


@query(cte("listings") + ", m AS (SELECT scraped_at::DATE AS day, count(*) AS n, count(*) FILTER (active) AS a, count(*) FILTER (lower(trim(coalesce(status, ''))) = 'solgt') AS s, count(*) FILTER (lower(trim(coalesce(status, ''))) = 'inaktiv') AS x FROM listings GROUP BY 1) SELECT day, '🏠 Today: +' || n || ' added, -' || (s + x) || ' removed (' || s || ' sold, ' || x || ' delisted). Active: ' || a || '.' AS message FROM m")
def daily_messages(spark, d) -> DataFrame:
    s = S.status_key("status")
    days = bound(spark, d, "listings").groupBy(F.to_date("scraped_at").alias("day")).agg(F.count("*").alias("n"), F.count_if("active").alias("a"), F.count_if(s == "solgt").alias("s"), F.count_if(s == "inaktiv").alias("x"))
    return days.select("day", C.daily_message(F.col("n"), F.col("s"), F.col("x"), F.col("a")).alias("message"))


@query(cte("sold", "listings", "ledger") + f"""
SELECT (SELECT count(*) FROM sold WHERE sold_price IS NOT NULL AND sold_at >= {AS_OF_SQL} - INTERVAL 2400 HOUR AND id IN (SELECT id FROM listings WHERE bra_i >= 50)) AS landed,
  (SELECT arg_max(outcome, (called_at, event_id)) = 'blocked' FROM ledger) AS suspended
""")
def landed_sales(spark, d) -> DataFrame:
    """Prices that came in lately for tracked rows, and whether the last call was blocked, which suspends further ones."""
    tracked = bound(spark, d, "listings").filter("bra_i >= 50").select("id")
    fresh = bound(spark, d, "sold").filter(F.col("sold_price").isNotNull() & (F.col("sold_at").cast("timestamp") >= as_of() - F.expr("INTERVAL 2400 HOUR"))).join(tracked, "id", "left_semi")
    last = bound(spark, d, "ledger").agg((F.max_by("outcome", F.struct("called_at", "event_id")) == "blocked").alias("suspended"))
    return fresh.agg(F.count("*").alias("landed")).join(last, F.lit(True))


@query(cte("listings", "findings", "facilities") + "SELECT count(*) AS listings, count(*) FILTER (id IN (SELECT id FROM findings)) AS with_findings, count(*) FILTER (id IN (SELECT id FROM facilities)) AS with_facilities, count(totalpris) AS with_details FROM listings")
def table_coverage(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings").select("id", "totalpris")
    for name in ("findings", "facilities"):
        rows = rows.join(bound(spark, d, name).select("id").distinct().withColumn(name, F.lit(1)), "id", "left")
    return rows.agg(F.count("*").alias("listings"), F.count("findings").alias("with_findings"), F.count("facilities").alias("with_facilities"), F.count("totalpris").alias("with_details"))


@query(cte("listings", "listings_b") + "SELECT 'a' AS source, id, adresse, pris FROM listings WHERE id IN ('1', '7', '32') UNION ALL SELECT 'b', 'b:' || substr(sha1(coalesce(url, '')), 1, 16), adresse, pris FROM listings_b WHERE b_id = '3'")
def listing_detail(spark, d) -> DataFrame:
    """Listings of either source by their public ids."""
    a = bound(spark, d, "listings").select(F.lit("a").alias("source"), "id", "adresse", "pris")
    b = bound(spark, d, "listings_b").select(F.lit("b").alias("source"), S.hash_id("url").alias("id"), "adresse", "pris", "b_id")
    wanted = b.filter("b_id = '3'").select("id").unionByName(spark.createDataFrame([("1",), ("7",), ("32",)], "id string"))
    # A handful of ids, so a broadcast of bounded size.
    return a.unionByName(b.drop("b_id")).join(F.broadcast(wanted), "id", "left_semi").select("source", "id", "adresse", "pris")


_KINDS = {"Tilgjengelighet": "status", "Adresse": "adresse", "Postnummer": "postnummer", "Boligtype": "boligtype"}
_NUMBERS = {"Pris": "pris", "Internt bruksareal (BRA-i)": "bra_i", "Byggeår": "byggeaar"}


@query(cte("listings") + "SELECT id, status AS tilgjengelighet, adresse, postnummer, boligtype AS info_property_type, CASE WHEN cast(id AS BIGINT) % 5 = 0 THEN NULL ELSE pris END AS pris, bra_i AS info_usable_i_area, byggeaar::BIGINT AS info_construction_year FROM listings")
def listing_columns(spark, d) -> DataFrame:
    """Fields as text, by their labels, to typed columns; numbers that are none become null."""
    labels = {"Tilgjengelighet": "tilgjengelighet", "Adresse": "adresse", "Postnummer": "postnummer", "Boligtype": "info_property_type", "Pris": "pris", "Internt bruksareal (BRA-i)": "info_usable_i_area", "Byggeår": "info_construction_year"}
    rows = bound(spark, d, "listings")
    raw = rows.select("id", *[F.col(c).cast("string").alias(k) for k, c in (_KINDS | _NUMBERS).items()]).withColumn("Pris", F.when(F.col("id").cast("long") % 5 == 0, "Solgt").otherwise(F.col("Pris")))
    return raw.select("id", *[F.col(f"`{k}`").alias(labels[k]) for k in _KINDS], *[S.rounded(F.col(f"`{k}`")).alias(labels[k]) for k in _NUMBERS])


@query(cte("listings") + "SELECT id, coalesce(cast(bra_i AS VARCHAR), '') AS bra_i, bra_i::DOUBLE AS raw_bra_i, coalesce(cast(pris AS VARCHAR), '') AS pris, pris::DOUBLE AS raw_pris, 'computed' AS pris_kvm_from FROM listings")
def raw_columns(spark, d) -> DataFrame:
    """Display texts with their numbers beside them, and a computed column that says where it is from."""
    rows = bound(spark, d, "listings")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("bra_i", "pris")]
    out = rows.select("id", *shown, *[S.number(c).alias(f"raw_{c}") for c in ("bra_i", "pris")], S.price_per_m2("pris", "bra_primary", "bra_i", "bra_total").alias("pris_kvm"))
    out = out.withMetadata("pris_kvm", {"from": "computed"})
    return out.select("id", "bra_i", "raw_bra_i", "pris", "raw_pris", F.lit(out.schema["pris_kvm"].metadata["from"]).alias("pris_kvm_from"))


@query(cte("geo", "listings") + "SELECT row_number() OVER (ORDER BY score DESC, field, value DESC, id) AS place, id, field, value, score FROM (SELECT id, 'brj' AS field, brj AS value, CASE WHEN brj > 100 THEN 3 ELSE 2 END AS score FROM geo WHERE brj > 90 UNION ALL SELECT id, 'mvv', mvv, CASE WHEN mvv > 100 THEN 3 ELSE 2 END FROM geo WHERE mvv > 90) ")
def sorted_findings(spark, d) -> DataFrame:
    """All findings in their places: by score, then field, then value."""
    geo = bound(spark, d, "geo")
    parts = [geo.filter(F.col(c) > 90).select("id", F.lit(c).alias("field"), F.col(c).alias("value"), F.when(F.col(c) > 100, 3).otherwise(2).alias("score")) for c in ("brj", "mvv")]
    order = [F.col("score").desc(), F.col("field"), F.col("value").desc(), F.col("id")]
    return L.placed(parts[0].unionByName(parts[1]), [], order).select("place", "id", "field", "value", "score")


@query(cte("listings") + "SELECT row_number() OVER (ORDER BY active, scraped_at DESC, id) AS place, id, active FROM listings")
def refresh_order(spark, d) -> DataFrame:
    """All rows in the order in which to visit them again: inactive ones first, newest first."""
    order = [F.col("active"), F.col("scraped_at").desc(), F.col("id")]
    return L.placed(bound(spark, d, "listings").select("id", "active", "scraped_at"), [], order).select("place", "id", "active")


_FILTERS = {"pris": (0, 5_000_000), "bra_i": (60, None), "byggeaar": (None, None), "brj": (None, None)}


@query(cte("listings") + "SELECT 'bra_i' AS field, count(*) FILTER (bra_i IS NOT NULL AND NOT bra_i >= 60) AS excluded FROM listings UNION ALL SELECT 'pris', count(*) FILTER (pris IS NOT NULL AND NOT (pris >= 0 AND pris <= 5000000)) FROM listings")
def active_filters(spark, d) -> DataFrame:
    """One row for each filter that is not at its default, with how many known values it leaves out."""
    rows, out = bound(spark, d, "listings"), None
    for name, (low, high) in _FILTERS.items():
        if low is None and high is None:
            continue
        c = F.col(name)
        outside = (c < low if low is not None else F.lit(False)) | (c > high if high is not None else F.lit(False))
        part = rows.agg(F.count_if(outside).alias("excluded")).select(F.lit(name).alias("field"), "excluded")
        out = part if out is None else out.unionByName(part)
    return out
