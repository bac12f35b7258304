"""Streams against their batch twins: out of order, late, repeated and failing deliveries."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from listaro.operators import aggregates as A
from listaro.streaming import jobs
from listaro.streaming.nightly import NightlyMerge
from listaro.streaming.replay import new_folder, replay, replayed, stream_session

OBSERVED = "id string, event_id long, status string, seconds long"


def observations(spark, rows):
    return spark.createDataFrame(rows, OBSERVED).withColumn("observed_at", F.timestamp_seconds("seconds")).drop("seconds")


def end(spark, seconds):
    return observations(spark, [("~", -1, None, seconds)])


def test_status_changes_in_any_order_equal_the_batch(spark):
    own, rng = stream_session(spark), random.Random(3)
    rows = [(str(rng.randrange(4)), i, rng.choice(["a", "b", " a", None]), 60 * i) for i in range(160)] + [("0", 500, "a", 60), ("0", 501, "b", 60)]
    came = sorted(rows, key=lambda r: r[3] + rng.randrange(3000))
    parts = [observations(own, came[i : i + 60]) for i in range(0, len(came), 60)]
    path, schema, _ = replayed(own, [*parts, end(own, 10**7)], lambda s: jobs.status_changes(s, "1 hour"), "t-changes")
    got = sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()))
    want = A.status_changes(observations(spark, rows)).select("id", "event_id", "old_status", "new_status")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 50


class CountingState:
    """A state that counts calls to it, with timers."""

    def __init__(self):
        self.calls, self.rows = 0, []

    def getListState(self, *_):
        self.calls, self.rows = 0, []
        return self

    getValueState = registerTimer = lambda self, *_: self.counted()

    def counted(self):
        self.calls += 1


def test_calls_to_the_state_do_not_grow_with_ids():
    """All ids that are dealt to one key go to the state at once."""
    calls = {}
    for ids in (3, 300):
        state, job = CountingState(), jobs.StatusChanges()
        state.appendList = lambda rows, state=state: state.counted()
        job.init(state)
        rows = [Row(id=str(i), at=i, event_id=i, status="a", observed_at=None) for i in range(ids)]
        assert list(job.handleInputRows((0,), iter(rows), None)) == []
        calls[ids] = state.calls
    assert calls[3] == calls[300]


def test_status_changes_of_ids_in_one_bucket(spark):
    own, rng = stream_session(spark), random.Random(4)
    rows = [(str(rng.randrange(40)), i, rng.choice(["a", "b", None]), 30 * i + 30) for i in range(400)]
    path, schema, _ = replayed(own, [observations(own, rows[:250]), observations(own, rows[250:]), end(own, 10**7)], lambda s: jobs.status_changes(s, "1 hour", buckets=2), "t-bucket")
    got = sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()))
    want = A.status_changes(observations(spark, rows)).select("id", "event_id", "old_status", "new_status")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100


def test_rows_beyond_the_watermark_are_dropped_and_counted(spark):
    own, day = stream_session(spark), 86400
    first = observations(own, [("1", 1, "a", 0), ("1", 2, "a", 10), ("2", 3, "b", 5 * day)])
    late = observations(own, [("1", 4, "a", 20), ("1", 5, "a", 4 * day + 5), (None, 6, "a", 4 * day + 6)])  # the first day is over, the fifth is not
    path, schema, runs = replayed(own, [first, late, end(own, 400 * day)], jobs.daily_counts, "t-days")
    got = sorted((str(r.day), r.status, r.n) for r in spark.read.schema(schema).parquet(path).collect())
    assert got == [("1970-01-01", "a", 2), ("1970-01-05", "a", 2), ("1970-01-06", "b", 1)]
    dropped = [sum(s["numRowsDroppedByWatermark"] for p in run.recentProgress for s in p["stateOperators"]) for run in runs]
    assert dropped == [0, 1, 0]


def page(night, i, ok=True, pris=1, status="x", event=None):
    return (night, str(i), ok, event if event is not None else i, pris, status)


PAGES = "night string, id string, ok boolean, event_id long, pris long, status string"


@pytest.fixture()
def merge(spark):
    return NightlyMerge(new_folder(spark, "t-nightly"), ("pris", "status"), spark.createDataFrame([], PAGES).schema)


def listings(merge, spark):
    return {r.id: (r.active, r.pris, str(r.updated_at)[:10]) for r in merge.table(spark).collect()}


def test_nights_gate_merge_and_repeat(spark, merge):
    nights = [
        [page("2024-01-01", i) for i in range(10)],
        [page("2024-01-02", i, pris=2 if i == 1 else 1) for i in range(8)],
        [page("2024-01-03", i, ok=i > 2) for i in range(6)],  # half of the pages fail: nothing is switched off
        [page("2024-01-02", i, pris=9) for i in range(3)],  # delivered again
        [page("2024-01-04", 9), page("2024-01-04", 9, pris=7, event=99), page("2024-01-05", 3), (None, "5", True, 1, 1, "x"), ("2024-01-05", None, True, 1, 1, "x")],
    ]
    replay(spark, [spark.createDataFrame(n, PAGES) for n in nights], merge.root, lambda s: s.writeStream.foreachBatch(merge))
    lines = {r.night: (r.crawled, r.failed, r.verdict, r.inserted, r.updated, r.deactivated) for r in merge.ledger(spark).collect()}
    assert lines == {
        "2024-01-01": (10, 0, "ok", 10, 0, 0), "2024-01-02": (8, 0, "ok", 0, 1, 2), "2024-01-03": (6, 3, "too many failures", 0, 0, 0),
        "2024-01-04": (2, 0, "ok", 0, 1, 8), "2024-01-05": (2, 0, "ok", 0, 1, 1),
    }
    now = listings(merge, spark)
    assert {i for i, (active, _, _) in now.items() if active} == {"3"}
    assert now["1"] == (False, 2, "2024-01-02")
    assert now["9"] == (False, 7, "2024-01-04") and now["0"][1] == 1


def test_a_repeat_and_a_death_change_nothing(spark, merge):
    rows = spark.createDataFrame([page("2024-01-01", i) for i in range(5)], PAGES)
    merge(rows, 0)
    before = listings(merge, spark)
    merge(rows.withColumn("pris", F.lit(5).cast("long")), 0)
    merge(rows.limit(0), 1)
    assert listings(merge, spark) == before and merge.ledger(spark).count() == 1
    # A run that died after it wrote its version and before its line: the version does not count, and is written anew.
    spark.createDataFrame([("zz", True, None, 1, "x")], "id string, active boolean, updated_at timestamp, pris long, status string").write.parquet(merge._version("2024-01-02"))
    assert listings(merge, spark) == before
    merge(spark.createDataFrame([page("2024-01-02", 1)], PAGES), 1)
    assert {i for i, x in listings(merge, spark).items() if x[0]} == {"1"} and "zz" not in listings(merge, spark)


def test_drift_is_held_against_the_table_before_the_merge(spark, merge):
    merge(spark.createDataFrame([page("2024-01-01", i) for i in range(250)], PAGES), 0)
    merge(spark.createDataFrame([page("2024-01-02", i, status="" if i % 5 else "x") for i in range(200)], PAGES), 1)
    assert {r.night: r.drift for r in merge.ledger(spark).collect()} == {"2024-01-01": [], "2024-01-02": ["status"]}
