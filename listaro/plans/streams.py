"""Queries that replay the events as streams; each equals a batch query on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.plans.bindings import bound, cte
from listaro.staging import read_table
from listaro.streaming import jobs
from listaro.streaming.nightly import NightlyMerge
from listaro.streaming.replay import new_folder, replay, replayed, stream_session

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Days of a delivery; rows come up to half a day after their time, some into the next delivery.
_DAYS = 8


def _deliveries(spark, d, late: bool) -> Iterator[DataFrame]:
    """The observations as they come in: out of order within half a day; with ``late`` every 97th after all others; then one row of the year after, which lets the watermark pass all."""
    rows = bound(spark, d, "observations").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    came = F.floor((F.unix_seconds("observed_at") + F.col("event_id") * 7919 % 43200) / (86400 * _DAYS))
    rows = rows.withColumn("came", F.when(F.lit(late) & (F.col("event_id") % 97 == 0), 1 << 40).otherwise(came))
    for r in rows.select("came").filter("came is not null").distinct().orderBy("came").collect():
        yield rows.filter(F.col("came") == r.came).drop("came")
    yield rows.agg(F.max("observed_at").alias("last")).select(F.lit("~").alias("id"), (F.col("last") + F.expr("INTERVAL 365 DAYS")).alias("observed_at"), F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("status"))


def _streamed(spark, d, job, label: str, late: bool) -> DataFrame:
    own = stream_session(spark)
    path, schema, _ = replayed(own, _deliveries(own, d, late), job, label)
    return spark.read.schema(schema).parquet(path)


@query(cte("observations") + ", c AS (SELECT id, event_id, trim(coalesce(status, '')) AS new_status, lag(trim(coalesce(status, ''))) OVER (PARTITION BY id ORDER BY observed_at, event_id) AS old_status FROM observations) SELECT id, event_id, old_status, new_status FROM c WHERE old_status IS NOT NULL AND old_status <> new_status")
def streamed_status_changes(spark, d) -> DataFrame:
    """Status changes of observations that come out of order."""
    return _streamed(spark, d, jobs.status_changes, "stream-changes", False)


_LATE = cte("observations") + ", o AS (SELECT *, event_id % 97 = 0 AS late FROM observations), w AS (SELECT max(observed_at) - INTERVAL 1 DAY AS passed FROM o WHERE NOT late)"


@query(_LATE + " SELECT observed_at::DATE AS day, status, count(*) AS n FROM o, w WHERE NOT late OR observed_at::DATE + INTERVAL 1 DAY > passed GROUP BY ALL")
def streamed_daily_counts(spark, d) -> DataFrame:
    """Each day's observations by status; every 97th comes after the others, and counts only for days that the watermark has not passed."""
    return _streamed(spark, d, jobs.daily_counts, "stream-days", True)


@query(_LATE + " SELECT (observed_at::DATE + k::INT) AS last_day, status, count(*) AS n FROM o, w, range(7) r(k) WHERE NOT late OR observed_at::DATE + k::INT + INTERVAL 1 DAY > passed GROUP BY ALL")
def streamed_weekly_counts(spark, d) -> DataFrame:
    """The same for the seven days up to each day; a late observation still counts for the weeks that are open."""
    return _streamed(spark, d, jobs.weekly_counts, "stream-weeks", True)


# The nightly merge


#: Six nights of crawled pages. A third of the ids is away each night; in the fourth night a third of the pages fails; in the fifth hardly a status is read.
_NIGHTS = 6
_PAGES = [
    "(day(ts) - 1) {div} 5 AS n", "'2024-02-0' || cast((day(ts) - 1) {div} 5 + 1 AS {text}) AS night", "cast(user_id * 10 + event_id % 10 AS {text}) AS id", "event_id",
    "CASE WHEN (day(ts) - 1) {div} 5 = 3 THEN event_id % 3 <> 0 ELSE event_id % 17 <> 0 END AS ok", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(floor(value) AS bigint) * 1000 END AS pris",
    "CASE WHEN (day(ts) - 1) {div} 5 = 4 AND event_id % 7 <> 0 THEN '' ELSE event_type END AS status",
]
_SEEN = "day(ts) <= 30 AND (user_id + (day(ts) - 1) {div} 5 * 7) % 3 <> 0"


def _after_nights(spark, d) -> NightlyMerge:
    """All nights merged, the second one delivered once more before the last, with other prices."""
    own = stream_session(spark)
    rows = read_table(own, f"{d}/events.parquet").where(_SEEN.replace("{div}", "div")).selectExpr(*[x.replace("{div}", "div").replace("{text}", "string") for x in _PAGES])
    schema = rows.drop("n").schema
    merge = NightlyMerge(new_folder(spark, "nightly"), ("pris", "status"), schema)
    nights = [rows.filter(F.col("n") == n).drop("n") for n in range(_NIGHTS)]
    again = nights[1].withColumn("pris", F.lit(1).cast("long"))
    replay(own, [*nights[:-1], again, nights[-1]], merge.root, lambda stream: stream.writeStream.foreachBatch(merge))
    return merge


def _night_sql(n: int) -> str:
    night = f"'2024-02-0{n + 1}'"
    rate = lambda c, t: f"(SELECT count(*) FILTER ({c} IS NOT NULL{' AND status <> ' + chr(39) * 2 if c == 'status' else ''})::DOUBLE / greatest(count(*), 1) FROM {t})"
    fell = lambda c: f"CASE WHEN (SELECT count(*) FROM q{n}) >= 100 AND (SELECT count(*) FROM s{n}) >= 200 AND {rate(c, f's{n}')} >= 0.05 AND {rate(c, f'q{n}')} < {rate(c, f's{n}')} * 0.4::DOUBLE THEN '{c}' END"
    return f"""
q{n} AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS k FROM p WHERE n = {n} AND ok) WHERE k = 1),
g{n} AS MATERIALIZED (SELECT count(*) AS crawled, count(*) FILTER (NOT ok) AS failed, CASE WHEN count(*) FILTER (NOT ok)::DOUBLE / count(*) > 0.2::DOUBLE THEN 'too many failures' ELSE 'ok' END AS verdict FROM p WHERE n = {n}),
m{n} AS MATERIALIZED (SELECT coalesce(s.id, q.id) AS id, CASE WHEN q.id IS NULL THEN s.pris ELSE q.pris END AS pris, CASE WHEN q.id IS NULL THEN s.status ELSE q.status END AS status,
  CASE WHEN q.id IS NOT NULL THEN true WHEN verdict = 'ok' THEN false ELSE s.active END AS active, coalesce(s.active, false) AS was_active, s.id IS NULL AS fresh,
  q.id IS NOT NULL AND (s.id IS NULL OR q.pris IS DISTINCT FROM s.pris OR q.status IS DISTINCT FROM s.status OR NOT s.active) AS changed, s.updated_at
  FROM s{n} s FULL JOIN q{n} q ON s.id = q.id CROSS JOIN g{n}),
s{n + 1} AS MATERIALIZED (SELECT id, pris, status, active, CASE WHEN changed THEN TIMESTAMP {night} ELSE updated_at END AS updated_at FROM m{n}),
l{n} AS (SELECT {night} AS night, crawled, failed, verdict, coalesce(concat_ws(',', {fell("pris")}, {fell("status")}), '') AS drift, (SELECT count(*) FILTER (fresh) FROM m{n}) AS inserted, (SELECT count(*) FILTER (changed AND NOT fresh) FROM m{n}) AS updated, (SELECT count(*) FILTER (was_active AND NOT active) FROM m{n}) AS deactivated FROM g{n})"""


_NIGHT_SQL = f"""WITH p AS MATERIALIZED (SELECT {", ".join(_PAGES)} FROM events WHERE {_SEEN}), s0 AS (SELECT id, pris, status, true AS active, TIMESTAMP '2024-01-01' AS updated_at FROM p WHERE false),""".replace("{div}", "//").replace("{text}", "VARCHAR") + ",".join(_night_sql(n) for n in range(_NIGHTS))


@query(_NIGHT_SQL + f" SELECT id, pris, status, active, updated_at FROM s{_NIGHTS}")
def streamed_nightly_merge(spark, d) -> DataFrame:
    """The listings after six streamed nights, one of which fails the gate and one of which is delivered twice."""
    return _after_nights(spark, d).table(spark).select("id", "pris", "status", "active", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(_NIGHT_SQL + "".join(f"{' UNION ALL' if n else ''} SELECT * FROM l{n}" for n in range(_NIGHTS)))
def streamed_nightly_ledger(spark, d) -> DataFrame:
    """What each of those nights did, in one line each."""
    return _after_nights(spark, d).ledger(spark).withColumn("drift", F.concat_ws(",", "drift")).drop("number")
