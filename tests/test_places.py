"""Rows that share places: whole results, and no pairs of single rows on the way."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from listaro.operators import aggregates as A
from listaro.operators import donors as D
from listaro.operators import joins as J
from tests.test_listings import metres

SPOTS = [(60 + 0.0015 * (i % 3), 10 + 0.003 * (i // 3)) for i in range(6)]


@pytest.fixture
def pairs(monkeypatch):
    """Sizes of all radius joins."""
    sizes, plain = [], J.radius_join

    def counted(*args):
        out = plain(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(J, "radius_join", counted)
    return sizes


def crowd(spark, n):
    rng = random.Random(n)
    rows = [(str(i), *rng.choice(SPOTS)) for i in range(n)]
    a = spark.createDataFrame(rows, "id string, lat double, lng double")
    return rows, a, a.select(F.col("id").alias("peer_id"), F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng"), F.col("id").cast("long").alias("rank"))


def near(p, q):
    return metres(*p[1:3], *q[1:3]) <= 300


def test_nearest_and_pair_counts(spark, pairs):
    rows, a, b = crowd(spark, 120)
    want = {p[0]: min((metres(*p[1:], *q[1:]), int(q[0])) for q in rows if q is not p)[1] for p in rows}
    assert {r.id: int(r.donor_id) for r in J.nearest_within(a, b, 300.0).collect()} == want
    among = [(p[0], q[0]) for p in rows for q in rows if p is not q and near(p, q)]
    assert tuple(J.count_pairs(a, 300.0).first()) == (len(among), len({p for p, _ in among}))
    assert tuple(J.count_pairs(a.filter("false"), 300.0).first()) == (0, 0)
    assert max(pairs) <= 2 * len(SPOTS) ** 2


def test_stations_by_place(spark, pairs):
    rows, a, b = crowd(spark, 120)
    stations = b.select(F.col("rank").alias("station_id"), F.col("peer_lat").alias("lat"), F.col("peer_lng").alias("lng"), F.lit(None).cast("int").alias("radius_m"))
    want = {p[0]: min(int(q[0]) for q in rows if q[1:] == p[1:]) for p in rows}
    assert {r.id: r.station_id for r in J.nearest_covering(a, stations).collect()} == want
    assert max(pairs) <= len(SPOTS) ** 2


def test_outliers_by_place(spark, pairs):
    rows, a, _ = crowd(spark, 120)
    value = {p[0]: 300 if int(p[0]) % 40 == 0 else 20 + int(p[0]) % 5 for p in rows}
    want = {}
    for p in rows:
        def stands_out(values, low):
            middle = statistics.median(values)
            far, spread = abs(value[p[0]] - middle), statistics.median(abs(v - middle) for v in values)
            return far >= max(low, 2.5 * max(spread, 1)) and far / max(abs(middle), 1) >= 0.35
        around = [value[q[0]] for q in rows if q is not p and near(p, q)]
        others = [value[q[0]] for q in rows if q is not p]
        want[p[0]] = (3 * stands_out(around, 20) + 2 * stands_out(others, 25), len(around), len(others))
    given = spark.createDataFrame([(p[0], value[p[0]], p[1], p[2], "1") for p in rows], "id string, value int, lat double, lng double, postcode string")
    assert {r.id: (r.score, r.near_n, r.post_n) for r in A.score_outliers(given, threshold=0).collect()} == want
    assert max(pairs) <= len(SPOTS) ** 2


@pytest.mark.parametrize("seed", range(2))
def test_donor_passes_by_place(spark, pairs, seed):
    rows, a, b = crowd(spark, 60 + seed)
    order = [p[0] for p in rows]
    place = {p[0]: p for p in rows}
    pool = [i for i in order if int(i) % 4]
    ranks = {i: -int(i) if seed else int(i) for i in pool}
    cands = b.withColumn("ord", F.col("peer_id").cast("long")).filter("rank % 4 != 0").withColumn("rank", F.expr("-rank" if seed else "rank"))
    frame = a.withColumn("ord", F.col("id").cast("long")).withColumn("donor", F.lit(None).cast("string"))
    link, callers, calls = {}, [], {}
    left = list(pool)
    for i in order:
        found = [(metres(*place[i][1:], *place[j][1:]), ranks[j], j) for j in left if j != i and near(place[i], place[j])]
        if found:
            link[i] = min(found)[2]
            if i in left:
                left.remove(i)
            link = {k: link[i] if v == i else v for k, v in link.items()}
        calls[i] = not any(near(place[i], place[j]) for j in callers)
        callers += [i] if calls[i] else []
    assert {r.id: r.donor_id for r in D.assign_donors(frame, cands, 300.0).collect()} == link
    assert {r.id: r.calls for r in D.estimate_growing(frame, 300.0).collect()} == calls
    assert max(pairs) <= 2 * len(SPOTS) ** 2


def test_what_is_around_a_place_is_counted_where_it_met(spark):
    """No pair of places is shuffled with its values again: the join by cells and the count of what is around lie in one stage."""
    rows = spark.createDataFrame([(str(i), float(10 + i % 60), 60.0 + i % 20 / 1e4, 10.0, "1") for i in range(400)], "id string, value double, lat double, lng double, postcode string")
    lines = A.score_outliers(rows)._jdf.queryExecution().executedPlan().toString().splitlines()
    met = next(i for i, line in enumerate(lines) if "Join [cell_y" in line)
    counted = max(i for i in range(met) if "collect_list(struct(v" in lines[i])
    assert not any("Exchange" in line for line in lines[counted:met])


def test_rows_without_a_pointer_do_not_meet_in_one_task(spark):
    rows = spark.createDataFrame([("1", 10, None, None), ("2", 20, 30, "1"), ("3", 40, None, " "), ("4", 5, 6, "gone"), ("5", None, 7, "2")], "id string, brj int, mvv int, donor string")
    out = J.resolve_donor(rows)
    want = {("1", 10, None, None), ("2", 10, 30, "1"), ("3", 40, None, " "), ("4", 5, 6, "gone"), ("5", 20, 30, "2")}
    assert {(r.id, r.brj, r.mvv, r.donor) for r in out.collect()} == want
    joined = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line or "Union" in line]
    assert "Union" in joined[0] and "Join" in joined[1]
