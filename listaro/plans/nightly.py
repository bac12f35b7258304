"""Queries of the nightly job: drift, merges, lifecycle, roll-ups, outliers, ranking, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import aggregates as A
from listaro.operators import joins as J
from listaro.operators import merge as M
from listaro.operators import ranking as R
from listaro.plans.bindings import AS_OF_SQL, as_of, bound, cte
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


STATUS = "lower(trim(coalesce(status, '')))"
WATCHED = ["pris", "bra_i", "postnummer", "adresse", "energimerke", "eieform", "byggeaar"]
_RATES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {{by}} count(*) FILTER ({c} IS NOT NULL{' AND ' + c + chr(39).join([' <> ', '', '']) if c in ('postnummer', 'adresse', 'energimerke', 'eieform') else ''})::DOUBLE / count(*) AS rate, count(*) AS n FROM {{src}} {{group}}" for c in WATCHED)


@query(cte("listings") + _RATES.format(by="", src="listings", group=""))
def baseline_rates(spark, d) -> DataFrame:
    return A.fill_rates(bound(spark, d, "listings"), WATCHED).select("column", "rate", "n")


def _batches(spark, d) -> DataFrame:
    """Nightly batches by month; in some the energy grade is hardly parsed."""
    month = F.date_format("scraped_at", "yyyy-MM")
    rows = bound(spark, d, "listings").withColumn("batch", month)
    return rows.withColumn("energimerke", F.when(F.substring("batch", 6, 2).isin("03", "07") & (F.col("id").cast("long") % 5 != 0), None).otherwise(F.col("energimerke")))


_BATCH_SQL = cte("listings") + """, b AS (SELECT * REPLACE (CASE WHEN strftime(scraped_at, '%m') IN ('03', '07') AND cast(id AS BIGINT) % 5 <> 0 THEN NULL ELSE energimerke END AS energimerke), strftime(scraped_at, '%Y-%m') AS batch FROM listings),
br AS (""" + _RATES.format(by="batch,", src="b", group="GROUP BY batch") + "), base AS (" + _RATES.format(by="", src="listings", group="") + ")"


@query(_BATCH_SQL + """ SELECT batch, br."column", br.rate, base.rate AS base_rate, br.n FROM br JOIN base ON br."column" = base."column"
WHERE br.n >= 100 AND base.n >= 200 AND base.rate >= 0.05 AND br.rate < base.rate * 0.4::DOUBLE""")
def drift_findings(spark, d) -> DataFrame:
    return A.drift_findings(A.fill_rates(_batches(spark, d), WATCHED, "batch"), A.fill_rates(bound(spark, d, "listings"), WATCHED), "batch")


@query("WITH b AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT count(*) AS n FROM documents) SELECT source, CASE WHEN b.n < 100 THEN 'skipped:batch' WHEN t.n < 200 THEN 'skipped:baseline' ELSE 'checked' END AS status FROM b, t")
def drift_status(spark, d) -> DataFrame:
    docs = read_table(spark, f"{d}/documents.parquet")
    total = docs.count()
    return docs.groupBy("source").agg(F.count("*").alias("n")).select("source", A.drift_status(F.col("n"), F.lit(total)).alias("status"))


@query(cte("listings") + ", m AS (SELECT postnummer, median(pris) AS median, count(pris) AS n FROM listings GROUP BY postnummer) SELECT m.postnummer, n, m.median, coalesce(x.mad, 0) AS mad FROM m LEFT JOIN (SELECT l.postnummer, median(abs(pris - m.median)) AS mad FROM listings l JOIN m ON l.postnummer = m.postnummer GROUP BY l.postnummer) x ON x.postnummer = m.postnummer")
def median_mad(spark, d) -> DataFrame:
    return A.median_mad(bound(spark, d, "listings").select("postnummer", F.col("pris").cast("double").alias("pris")), "postnummer", "pris")


_DIST = "2 * 6371000.0 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)), sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(cte("geo", "listings") + f"""
, r AS (SELECT g.id, brj::DOUBLE AS value, lat, lng, cast(cast(postnummer AS BIGINT) % 40 AS VARCHAR) AS pc FROM geo g JOIN listings USING (id) WHERE brj BETWEEN 1 AND 360),
np AS (SELECT a.id, a.value, b.value AS pv FROM r a JOIN r b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.003 AND abs(a.lng - b.lng) < 0.006 WHERE {_DIST} <= 300),
nm AS (SELECT id, any_value(value) AS value, median(pv) AS med, count(*) AS n FROM np GROUP BY id),
nd AS (SELECT np.id, median(abs(pv - med)) AS mad FROM np JOIN nm ON np.id = nm.id GROUP BY np.id),
near AS (SELECT nm.id, n AS near_n, n >= 5 AND abs(value - med) >= greatest(20, 2.5 * greatest(mad, 1)) AND abs(value - med) / greatest(abs(med), 1) >= 0.35 AS hit FROM nm JOIN nd ON nm.id = nd.id),
pp AS (SELECT a.id, a.value, b.value AS pv FROM r a JOIN r b ON a.pc = b.pc AND a.id <> b.id),
pm AS (SELECT id, any_value(value) AS value, median(pv) AS med, count(*) AS n FROM pp GROUP BY id),
pd AS (SELECT pp.id, median(abs(pv - med)) AS mad FROM pp JOIN pm ON pp.id = pm.id GROUP BY pp.id),
post AS (SELECT pm.id, n AS post_n, n >= 6 AND abs(value - med) >= greatest(25, 2.5 * greatest(mad, 1)) AND abs(value - med) / greatest(abs(med), 1) >= 0.35 AS hit FROM pm JOIN pd ON pm.id = pd.id)
SELECT r.id, cast(CASE WHEN coalesce(near.hit, false) THEN 3 ELSE 0 END + CASE WHEN coalesce(post.hit, false) THEN 2 ELSE 0 END AS INTEGER) AS score, coalesce(near_n, 0) AS near_n, coalesce(post_n, 0)::BIGINT AS post_n
FROM r LEFT JOIN near USING (id) LEFT JOIN post USING (id) WHERE score >= 2
""")
def score_outliers(spark, d) -> DataFrame:
    rows = bound(spark, d, "geo").select("id", F.col("brj").alias("value"), "lat", "lng").join(bound(spark, d, "listings").select("id", (F.col("postnummer").cast("long") % 40).cast("string").alias("postcode")), "id")
    return A.score_outliers(rows, threshold=2)


_SEV = "CASE alvorlighet WHEN 'kosmetisk' THEN 1 WHEN 'mindre' THEN 2 WHEN 'vesentlig' THEN 3 ELSE 4 END"


@query(cte("findings") + f"""
SELECT id, count(*) FILTER (tg = 2) AS tg2, count(*) FILTER (tg = 3) AS tg3,
  sum(kostnad_lav) FILTER (kostnad_hoy IS NOT NULL)::BIGINT AS lav, sum(kostnad_hoy) FILTER (kostnad_lav IS NOT NULL)::BIGINT AS hoy,
  cast(floor(sum((kostnad_lav + kostnad_hoy) / 2.0) / 10000 + 0.5) AS BIGINT) * 10000 AS est,
  CASE WHEN count(DISTINCT kostnad_kilde) FILTER (kostnad_lav IS NOT NULL) = 1 THEN min(kostnad_kilde) FILTER (kostnad_lav IS NOT NULL) WHEN count(DISTINCT kostnad_kilde) FILTER (kostnad_lav IS NOT NULL) > 1 THEN 'blandet' END AS kilde,
  arg_max(alvorlighet, ({_SEV}, coalesce(kostnad_hoy, 0), -pos, bygningsdel)) AS alvorlighet, arg_max(bygningsdel, ({_SEV}, coalesce(kostnad_hoy, 0), -pos, bygningsdel)) AS verste
FROM findings GROUP BY id
""")
def rollup_findings(spark, d) -> DataFrame:
    return A.rollup_findings(bound(spark, d, "findings"))


@query(cte("findings") + """
, s AS (SELECT id, kostnad_hoy AS cost, row_number() OVER (PARTITION BY id ORDER BY kostnad_hoy, pos, bygningsdel) AS rk FROM findings WHERE kostnad_kilde = 'takst'),
e AS (SELECT id, kostnad_hoy AS cost, row_number() OVER (PARTITION BY id ORDER BY kostnad_hoy, pos, bygningsdel) AS rk FROM findings WHERE kostnad_kilde = 'estimat')
SELECT count(*) FILTER (s.cost = e.cost) AS exact, count(*) FILTER (e.cost > s.cost) AS higher, count(*) FILTER (e.cost < s.cost) AS lower, count(*) FILTER (s.cost IS NULL OR e.cost IS NULL) AS unmatched
FROM s FULL JOIN e ON s.id = e.id AND s.rk = e.rk
""")
def band_accuracy(spark, d) -> DataFrame:
    rows = bound(spark, d, "findings").select("id", "pos", F.col("bygningsdel").alias("part"), F.col("kostnad_hoy").alias("cost"), "kostnad_kilde")
    return A.band_accuracy(rows.filter("kostnad_kilde = 'takst'"), rows.filter("kostnad_kilde = 'estimat'"), "id")


@query(cte("listings") + f"""
, p AS (SELECT id FROM listings WHERE scraped_at < TIMESTAMP '1996-01-01'), c AS (SELECT id FROM listings WHERE active AND cast(id AS BIGINT) % 3 <> 0), s AS (SELECT id FROM listings WHERE {STATUS} = 'solgt')
SELECT id, 'added' AS change FROM c WHERE id NOT IN (SELECT id FROM p)
UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN 'removed_sold' ELSE 'removed_delisted' END FROM p WHERE id NOT IN (SELECT id FROM c)
""")
def snapshot_diff(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings")
    before = rows.filter(F.col("scraped_at") < F.lit("1996-01-01").cast("timestamp_ntz")).select("id")
    return A.snapshot_diff(before, rows.filter("active and cast(id as bigint) % 3 != 0").select("id"), rows.filter(S.status_key("status") == "solgt").select("id"))


@query(cte("observations") + """
, w AS (SELECT id, event_id, trim(coalesce(status, '')) AS new_status, lag(trim(coalesce(status, ''))) OVER (PARTITION BY id ORDER BY observed_at, event_id) AS old_status FROM observations)
SELECT id, event_id, old_status, new_status FROM w WHERE old_status IS NOT NULL AND old_status <> new_status
""")
def status_changes(spark, d) -> DataFrame:
    return A.status_changes(bound(spark, d, "observations"))


@query(cte("observations") + """
, c AS (SELECT id, event_id, observed_at::DATE AS day, trim(coalesce(status, '')) AS s, lag(trim(coalesce(status, ''))) OVER (PARTITION BY id ORDER BY observed_at, event_id) AS o FROM observations),
dd AS (SELECT day, count(*) AS changes, count(*) FILTER (s = 'purchase') AS sold FROM c WHERE o IS NOT NULL AND o <> s GROUP BY day)
SELECT a.day, a.changes, sum(b.changes)::BIGINT AS week_changes, sum(b.sold)::BIGINT AS week_sold FROM dd a JOIN dd b ON b.day BETWEEN a.day - 6 AND a.day GROUP BY a.day, a.changes
""")
def weekly_metrics(spark, d) -> DataFrame:
    """Daily status changes with the trailing seven days' sums; days without any count as nothing."""
    rows = bound(spark, d, "observations")
    changes = A.status_changes(rows).join(rows.select("event_id", F.to_date("observed_at").alias("day")), "event_id")
    daily = changes.groupBy("day").agg(F.count("*").alias("changes"), F.count_if(F.col("new_status") == "purchase").alias("sold"))
    # Each day goes to the seven days that it counts for, so no window over all days is needed.
    ahead = daily.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add("day", i))).alias("day"), F.col("changes").alias("c"), "sold")
    return daily.select("day", "changes").join(ahead, "day").groupBy("day", "changes").agg(F.sum("c").alias("week_changes"), F.sum("sold").alias("week_sold"))


@query(cte("ledger") + "SELECT api, strftime(called_at, '%Y-%m') AS month, count(*) FILTER (outcome IN ('ok', 'error')) AS calls FROM ledger GROUP BY 1, 2")
def month_usage(spark, d) -> DataFrame:
    return bound(spark, d, "ledger").groupBy("api", F.date_format("called_at", "yyyy-MM").alias("month")).agg(F.count_if(F.col("outcome").isin("ok", "error")).alias("calls"))


@query(cte("ledger") + "SELECT api, month, place, place <= 800 AS allowed, event_id FROM (SELECT api, strftime(called_at, '%Y-%m') AS month, event_id, row_number() OVER (PARTITION BY api, strftime(called_at, '%Y-%m') ORDER BY called_at, event_id) AS place FROM ledger WHERE outcome <> 'blocked')")
def apply_budget(spark, d) -> DataFrame:
    return A.apply_budget(bound(spark, d, "ledger"), 800).select("api", "month", "place", "allowed", "event_id")


@query(cte("ledger") + ", p AS (SELECT api, strftime(called_at, '%Y-%m') AS month, row_number() OVER (PARTITION BY api, strftime(called_at, '%Y-%m') ORDER BY called_at, event_id) AS place FROM ledger WHERE outcome <> 'blocked') SELECT api, month, pct, min(place) AS place FROM p, (VALUES (50), (80), (100)) v(pct) WHERE place * 100 >= pct * 500 GROUP BY api, month, pct")
def budget_warnings(spark, d) -> DataFrame:
    return A.budget_warnings(bound(spark, d, "ledger"), 500)


@query(cte("facilities") + "SELECT facility, count(*) AS n FROM facilities GROUP BY facility")
def facility_vocabulary(spark, d) -> DataFrame:
    return bound(spark, d, "facilities").groupBy("facility").agg(F.count("*").alias("n"))


@query(cte("listings") + "SELECT 'energimerke' AS field, coalesce(trim(energimerke), '') AS value, count(*) AS n FROM listings GROUP BY 2 UNION ALL SELECT 'eieform', coalesce(trim(eieform), ''), count(*) FROM listings GROUP BY 2 UNION ALL SELECT 'boligtype', coalesce(trim(boligtype), ''), count(*) FROM listings GROUP BY 2")
def vocabularies(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings")
    parts = [A.vocabulary(rows, c).select(F.lit(c).alias("field"), "value", "n") for c in ("energimerke", "eieform", "boligtype")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(cte("listings") + f"SELECT coalesce(boligtype, 'annet') AS kind, count(*) AS n, count(*) FILTER (active) AS n_active, count(*) FILTER (NOT active AND {STATUS} = 'solgt') AS n_sold FROM listings GROUP BY 1")
def group_counts(spark, d) -> DataFrame:
    return bound(spark, d, "listings").groupBy(F.coalesce("boligtype", F.lit("annet")).alias("kind")).agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"), F.count_if(~F.col("active") & (S.status_key("status") == "solgt")).alias("n_sold"))


@query(cte("listings", "geo", "sold") + f"""
SELECT count(*) AS total, count(sold_price) AS priced, CASE WHEN count(*) > 0 THEN count(sold_price)::DOUBLE / count(*) ELSE 0.0::DOUBLE END AS coverage
FROM listings l JOIN geo g USING (id) LEFT JOIN sold s USING (id) WHERE {STATUS} = 'solgt' AND lat IS NOT NULL AND lng IS NOT NULL AND updated_at < {AS_OF_SQL} - INTERVAL 100 DAY
""")
def sale_coverage(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings").filter((S.status_key("status") == "solgt") & (F.col("updated_at").cast("timestamp") < as_of() - F.expr("INTERVAL 100 DAY")))
    rows = rows.join(bound(spark, d, "geo").filter("lat is not null and lng is not null").select("id"), "id").join(bound(spark, d, "sold").select("id", "sold_price"), "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("sold_price").alias("priced")).withColumn("coverage", F.when(F.col("total") > 0, F.col("priced") / F.col("total")).otherwise(0.0))


@query(cte("listings", "geo") + "SELECT count(*) AS n, count(*) FILTER (brj IS NULL) AS no_brj, count(*) FILTER (mvv IS NULL) AS no_mvv, count(*) FILTER (lat IS NULL) AS no_place FROM listings LEFT JOIN geo USING (id)")
def missing_counts(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings").select("id").join(bound(spark, d, "geo"), "id", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("brj").isNull()).alias("no_brj"), F.count_if(F.col("mvv").isNull()).alias("no_mvv"), F.count_if(F.col("lat").isNull()).alias("no_place"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_stats(spark, d) -> DataFrame:
    parts = [read_table(spark, f"{d}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# Ranking


@query(cte("listings", "geo") + f"""
, r AS (SELECT l.*, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.brj IS NOT NULL THEN s.brj ELSE g.brj END AS brj, CASE WHEN trim(coalesce(g.donor, '')) <> '' AND s.mvv IS NOT NULL THEN s.mvv ELSE g.mvv END AS mvv, coalesce(bra_total, bra_primary, bra_i) AS area
 FROM listings l LEFT JOIN geo g USING (id) LEFT JOIN geo s ON s.id = g.donor)
SELECT id, CASE WHEN {STATUS} = 'solgt' THEN 2 WHEN active AND {STATUS} NOT IN ('solgt', 'inaktiv') THEN 0 ELSE 1 END AS tier,
  CASE WHEN coalesce(area < 80 OR brj > 70 OR mvv > 70, false) THEN 2 WHEN coalesce(area >= 80 AND brj BETWEEN 0 AND 70 AND mvv BETWEEN 0 AND 70, false) THEN 0 ELSE 1 END AS band FROM r
""")
def classification_order(spark, d) -> DataFrame:
    return R.classification_order(bound(spark, d, "listings"), bound(spark, d, "geo"))


_TARGETS = cte("listings", "geo", "sold", "attempts") + f"""
, t AS (SELECT l.id, lat, lng, {STATUS} AS status, coalesce(a.attempts, 0) AS attempts FROM listings l JOIN geo g USING (id) LEFT JOIN sold s USING (id) LEFT JOIN attempts a USING (id)
 WHERE ({STATUS} = 'solgt' OR ({STATUS} = 'inaktiv' AND updated_at >= {AS_OF_SQL} - INTERVAL 180 DAY)) AND lat IS NOT NULL AND lng IS NOT NULL AND sold_price IS NULL
   AND updated_at < {AS_OF_SQL} - INTERVAL 100 DAY AND coalesce(a.attempts, 0) < 5),
dens AS (SELECT a.id, count(*) AS density FROM t a JOIN t b ON abs(b.lat - a.lat) <= 0.01::DOUBLE AND abs(b.lng - a.lng) <= 0.02::DOUBLE GROUP BY a.id),
td AS (SELECT t.*, density FROM t JOIN dens USING (id))
"""


def _targets(spark, d) -> DataFrame:
    return R.sale_targets(bound(spark, d, "listings"), bound(spark, d, "geo"), bound(spark, d, "sold"), bound(spark, d, "attempts"), as_of())


@query(_TARGETS + "SELECT id, status, attempts, density FROM td")
def sale_targets(spark, d) -> DataFrame:
    return R.with_density(_targets(spark, d)).select("id", "status", "attempts", "density")


@query(_TARGETS + """
, f AS (SELECT * FROM td WHERE status = 'solgt' ORDER BY attempts, density DESC, cast(id AS BIGINT) LIMIT (SELECT CASE WHEN count(*) FILTER (status <> 'solgt') > 0 THEN 30 ELSE 40 END FROM td)),
o AS (SELECT * FROM td WHERE status <> 'solgt' ORDER BY attempts, density DESC, cast(id AS BIGINT) LIMIT (SELECT 40 - count(*) FROM f))
SELECT id, status FROM f UNION ALL SELECT id, status FROM o
""")
def allocate_budget(spark, d) -> DataFrame:
    return R.allocate_budget(R.with_density(_targets(spark, d)), 40, 10).select("id", "status")


@query(cte("geo") + ", w AS (SELECT id, 0 AS place, 'brj' AS destination FROM geo WHERE brj IS NULL UNION ALL SELECT id, 1, 'mvv' FROM geo WHERE mvv IS NULL) SELECT id, destination FROM w ORDER BY cast(id AS BIGINT), place LIMIT 101")
def limit_calls(spark, d) -> DataFrame:
    return R.limit_calls(bound(spark, d, "geo"), ("brj", "mvv"), 101)


@query("WITH c AS (SELECT l_partkey AS card_id, arg_min(l_orderkey, (l_orderkey * 8 + l_linenumber, l_orderkey)) AS request_id FROM lineitem GROUP BY l_partkey) SELECT card_id, CASE WHEN card_id % 3 = 0 THEN 'matched' ELSE 'neighbour' END AS kind, CASE WHEN card_id % 3 <> 0 THEN request_id END AS near_id FROM c")
def assign_cards(spark, d) -> DataFrame:
    cards = read_table(spark, f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("card_id"), F.col("l_orderkey").alias("request_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request_no"))
    return R.assign_cards(cards, cards.filter("card_id % 3 = 0").select(F.col("card_id").alias("id")).distinct())


# Merges

_MERGE_COLS = ["pris", "adresse", "postnummer"]


def _incoming(spark, d) -> DataFrame:
    """A nightly batch: a third of the listings again, every other one dearer, and some new ones."""
    k = F.col("id").cast("long")
    return bound(spark, d, "listings").filter(k % 3 == 0).select(F.when(k % 15 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id"), F.when(k % 2 == 0, F.col("pris") + 1000).otherwise(F.col("pris")).alias("pris"), "adresse", "postnummer")


_IN_SQL = ", inc AS (SELECT CASE WHEN cast(id AS BIGINT) % 15 = 0 THEN 'n' || id ELSE id END AS id, CASE WHEN cast(id AS BIGINT) % 2 = 0 THEN pris + 1000 ELSE pris END AS pris, adresse, postnummer FROM listings WHERE cast(id AS BIGINT) % 3 = 0)"


@query(cte("listings") + _IN_SQL + f"""
, j AS (SELECT coalesce(l.id, i.id) AS id, l.id AS lid, i.id AS iid, l.pris AS p0, i.pris AS p1, l.adresse AS a0, i.adresse AS a1, l.postnummer AS c0, i.postnummer AS c1, active, updated_at,
  (l.pris IS DISTINCT FROM i.pris OR l.adresse IS DISTINCT FROM i.adresse OR l.postnummer IS DISTINCT FROM i.postnummer OR NOT active) AS dif FROM listings l FULL JOIN inc i ON l.id = i.id)
SELECT id, CASE WHEN iid IS NOT NULL THEN p1 ELSE p0 END AS pris, CASE WHEN iid IS NOT NULL THEN true ELSE active END AS active,
  CASE WHEN iid IS NOT NULL AND (lid IS NULL OR dif) THEN {AS_OF_SQL} ELSE updated_at END AS updated_at,
  CASE WHEN lid IS NULL THEN 'inserted' WHEN iid IS NOT NULL AND dif THEN 'updated' ELSE 'same' END AS outcome FROM j
""")
def upsert_listings(spark, d) -> DataFrame:
    return M.upsert_listings(bound(spark, d, "listings"), _incoming(spark, d), _MERGE_COLS, as_of()).select("id", "pris", "active", "updated_at", "outcome")


_SALE_RULES = {"sold_price": "fill", "near_id": "first", "price_suggestion": "set", "size": "set", "collective_debt": "set"}


@query(cte("sold") + """
, inc AS (SELECT CASE WHEN cast(id AS BIGINT) % 5 = 0 THEN 'n' || id ELSE id END AS id, CASE WHEN cast(id AS BIGINT) % 3 = 0 THEN sold_price + 5 END AS sold_price, 'x' AS near_id, price_suggestion, size + 1 AS size, CAST(NULL AS BIGINT) AS collective_debt FROM sold WHERE cast(id AS BIGINT) % 2 = 0)
SELECT coalesce(s.id, i.id) AS id, coalesce(i.sold_price, s.sold_price) AS sold_price, coalesce(s.near_id, i.near_id) AS near_id,
  CASE WHEN i.id IS NOT NULL THEN i.price_suggestion ELSE s.price_suggestion END AS price_suggestion, CASE WHEN i.id IS NOT NULL THEN i.size ELSE s.size END AS size, CASE WHEN i.id IS NOT NULL THEN i.collective_debt ELSE s.collective_debt END AS collective_debt
FROM sold s FULL JOIN inc i ON s.id = i.id
""")
def upsert_sales(spark, d) -> DataFrame:
    base = bound(spark, d, "sold")
    k = F.col("id").cast("long")
    inc = base.filter(k % 2 == 0).select(F.when(k % 5 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id"), F.when(k % 3 == 0, F.col("sold_price") + 5).alias("sold_price"), F.lit("x").alias("near_id"), "price_suggestion", (F.col("size") + 1).alias("size"), F.lit(None).cast("long").alias("collective_debt"))
    return M.merge_by_rules(base, inc, _SALE_RULES)


@query(cte("facilities") + ", inc AS (SELECT DISTINCT id, 'ny' AS facility FROM facilities WHERE cast(id AS BIGINT) % 4 = 0) SELECT id, facility FROM facilities WHERE id NOT IN (SELECT id FROM inc) UNION ALL SELECT id, facility FROM inc")
def replace_children(spark, d) -> DataFrame:
    rows = bound(spark, d, "facilities")
    return M.replace_children(rows, rows.filter("cast(id as bigint) % 4 = 0").select("id", F.lit("ny").alias("facility")))


_NOTES = "notes AS (SELECT cast(c_custkey AS VARCHAR) AS id, c_mktsegment AS note, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '1998-01-01' END AS imported_at, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '1998-02-02' END AS updated_at FROM customer)"


def _notes(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    first, later = F.lit("1998-01-01").cast("timestamp"), F.lit("1998-02-02").cast("timestamp")
    return read_table(spark, f"{d}/customer.parquet").select(k.cast("string").alias("id"), F.col("c_mktsegment").alias("note"), F.when(k % 3 != 0, first).alias("imported_at"), F.when((k % 3 != 0) & (k % 4 != 0), first).otherwise(later).alias("updated_at"))


@query(f"""WITH {_NOTES}, imp AS (SELECT CASE WHEN cast(id AS BIGINT) % 7 = 0 THEN 'n' || id ELSE id END AS id, CASE WHEN cast(id AS BIGINT) % 2 = 0 THEN note ELSE lower(note) END AS note FROM notes),
j AS (SELECT coalesce(s.id, i.id) AS id, s.note AS n0, i.note AS n1, imported_at, updated_at, i.id IS NOT NULL AND (s.id IS NULL OR (s.note IS DISTINCT FROM i.note AND updated_at IS NOT DISTINCT FROM imported_at)) AS written FROM notes s FULL JOIN imp i ON s.id = i.id)
SELECT id, CASE WHEN written THEN n1 ELSE n0 END AS note, CASE WHEN written THEN {AS_OF_SQL} ELSE imported_at END AS imported_at, CASE WHEN written THEN {AS_OF_SQL} ELSE updated_at END AS updated_at, written FROM j""")
def import_protected(spark, d) -> DataFrame:
    notes = _notes(spark, d)
    k = F.col("id").cast("long")
    imported = notes.select(F.when(k % 7 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id"), F.when(k % 2 == 0, F.col("note")).otherwise(F.lower("note")).alias("note"))
    return M.import_protected(notes, imported, as_of())


@query(f"""WITH {_NOTES}, ed AS (SELECT CASE WHEN cast(id AS BIGINT) % 11 = 0 THEN 'n' || id ELSE id END AS id, CASE WHEN cast(id AS BIGINT) % 4 = 0 THEN ' ' ELSE ' sett ' END AS note FROM notes WHERE cast(id AS BIGINT) % 2 = 0),
j AS (SELECT coalesce(s.id, e.id) AS id, s.note AS n0, trim(e.note) AS n1, e.id IS NOT NULL AS edited, imported_at, updated_at FROM notes s FULL JOIN ed e ON s.id = e.id)
SELECT id, CASE WHEN edited AND n1 = '' THEN NULL WHEN edited THEN n1 ELSE n0 END AS note, imported_at, CASE WHEN edited THEN {AS_OF_SQL} ELSE updated_at END AS updated_at FROM j WHERE NOT (edited AND n1 = '' AND imported_at IS NULL)""")
def apply_edits(spark, d) -> DataFrame:
    notes = _notes(spark, d)
    k = F.col("id").cast("long")
    edits = notes.filter(k % 2 == 0).select(F.when(k % 11 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id"), F.when(k % 4 == 0, " ").otherwise(" sett ").alias("note"))
    return M.apply_edits(notes, edits, as_of())


@query(cte("listings") + f", n AS (SELECT id, CASE WHEN cast(id AS BIGINT) % 4 = 0 THEN 'Solgt' WHEN cast(id AS BIGINT) % 4 = 2 THEN '' END AS status FROM listings WHERE cast(id AS BIGINT) % 2 = 0) SELECT l.id, CASE WHEN n.id IS NOT NULL AND coalesce(l.status, '') <> coalesce(n.status, '') THEN n.status ELSE l.status END AS status, n.id IS NOT NULL AND coalesce(l.status, '') <> coalesce(n.status, '') AS changed FROM listings l LEFT JOIN n USING (id)")
def apply_status(spark, d) -> DataFrame:
    rows = bound(spark, d, "listings")
    k = F.col("id").cast("long")
    news = rows.filter(k % 2 == 0).select("id", F.when(k % 4 == 0, "Solgt").otherwise("").alias("status"))
    return M.apply_status(rows.select("id", "status", "updated_at"), news, as_of()).select("id", "status", "changed")


@query(cte("attempts", "sold") + "SELECT id, sum(attempts)::BIGINT AS attempts FROM (SELECT id, attempts FROM attempts UNION ALL SELECT id, 1 FROM sold) GROUP BY id")
def record_attempts(spark, d) -> DataFrame:
    return M.record_attempts(bound(spark, d, "attempts"), bound(spark, d, "sold"))


@query(cte("geo") + """
SELECT id, donor AS root FROM geo WHERE coalesce(trim(donor), '') <> ''
""")
def chain_roots(spark, d) -> DataFrame:
    """Representative of each donor chain. Every pointer here leads to a row without one, so a root is the direct target."""
    links = bound(spark, d, "geo").filter(F.coalesce(F.trim("donor"), F.lit("")) != "").select("id", F.col("donor").alias("target"))
    return J.chain_roots(links)
