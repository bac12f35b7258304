"""Scalars, policies and the two operators that restate a loop, against hand-made rows and replays."""

import math
import random

import pytest
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import aggregates as A
from listaro.operators import donors as D
from listaro.operators import filters as O
from listaro.operators import joins as J
from listaro.operators import merge as M
from listaro.operators import prose as P
from listaro.operators import publish as B
from listaro.sources import pages as L


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


@pytest.mark.parametrize(
    "make, given, wanted",
    [
        (S.title_case, ["2a o'brien", "", None, "ÅSE-gata"], ["2A O'Brien", "", None, "Åse-Gata"]),
        (S.postcode_key, ["581", "0581", "581.0", None, "ab"], ["0581", "0581", "0581", "", "ab"]),
        (S.padded_postcode, ["581", "12345", " x ", None, "581.0"], ["0581", "12345", "x", "", "0581"]),
        (S.clean_address, ["Vei 1 - a (b)", "Vei 2 (b)", "Vei 3 /c", "", None], ["Vei 1", "Vei 2", "Vei 3", "", None]),
        (S.address_key, ["Vei. 1,  (B)", None], ["vei 1 b", ""]),
        (S.rounded, ["2.5", "3.5", "x", None], [2, 4, None, None]),
        (S.duration_minutes, ["119s", "60s", "59s", "999999s", None, "x"], [1, 1, -2, -2, -1, -1]),
        (S.last_digits, ["a12b345c", "x"], ["345", None]),
        (S.amount, ["1 234 kr", "kr", None], [1234, None, None]),
    ],
)
def test_text_scalars(spark, make, given, wanted):
    assert values(spark, make("x"), given) == wanted


def test_known_zero_is_not_unknown(spark):
    rows = [(None, 12), (0, None), (5, 18)]
    assert values(spark, S.monthly_cost("a", "b"), rows, "a long, b long") == [None, 0, 7]
    assert values(spark, S.half_range("a", "b"), [(3, 8), (None, 2)], "a long, b long") == [2, None]


def test_closed_status_boundary(spark):
    rows = spark.sql("SELECT * FROM VALUES (false, 'Inaktiv', CAST(NULL AS BIGINT), TIMESTAMP'2020-01-01'), (false, ' inaktiv', 5L, TIMESTAMP'2020-01-01'), (false, 'Solgt', NULL, NULL), (true, 'Solgt', NULL, NULL), (false, 'Inaktiv', NULL, NULL) t(active, status, price, updated)")
    at = F.lit("2020-06-29 00:00:00").cast("timestamp")
    assert [r[0] for r in rows.select(S.closed_status("active", "status", "price", "updated", at, 180)).collect()] == ["Trukket", "Solgt", "Solgt", None, "Inaktiv"]


def test_unknown_price_policies(spark):
    rows = spark.createDataFrame([("1", None, True, None, 50), ("2", None, False, "Solgt", 50)], "id string, pris long, active boolean, status string, bra_i long")
    assert O.visible_active(rows).count() == 0 and O.visible_closed(rows).count() == 1


def test_polygon(spark):
    square = ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))
    rows = [(1.0, 1.0), (3.0, 1.0), (None, 1.0), (-0.1, 1.9)]
    assert values(spark, O.in_polygon(F.col("a"), F.col("b"), square), rows, "a double, b double") == [True, False, None, False]


def metres(lat1, lng1, lat2, lng2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * S.EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def scattered(rng, n):
    return [(str(i), 60 + rng.random() * 0.02, 10 + rng.random() * 0.04) if rng.random() > 0.1 else (str(i), None, None) for i in range(n)]


def test_radius_join_equals_brute_force_and_has_no_cross_join(spark):
    points = scattered(random.Random(1), 120)
    a = spark.createDataFrame(points, "id string, lat double, lng double")
    b = a.select(F.col("id").alias("peer_id"), F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng"))
    joined = J.radius_join(a, b, 300.0)
    got = {(r.id, r.peer_id) for r in joined.collect()}
    assert got == {(p[0], q[0]) for p in points for q in points if p[1] and q[1] and metres(*p[1:], *q[1:]) <= 300}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_donor_pass_equals_its_replay(spark, seed):
    rng = random.Random(seed)
    points = scattered(rng, 60)
    pointers = {p[0]: str(rng.randrange(60)) if rng.random() < 0.15 else None for p in points}
    ids = [p[0] for p in points if p[1] and not pointers[p[0]] and rng.random() < 0.8]
    place = {p[0]: p[1:] for p in points}
    pool, link, assigned = list(ids), dict(pointers), {}
    for i, lat, lng in points:
        if lat and not link[i]:
            near = [(metres(lat, lng, *place[j]), ids.index(j), j) for j in pool if j != i and metres(lat, lng, *place[j]) <= 300]
            if near:
                link[i] = assigned[i] = min(near)[2]
                if i in pool:
                    pool.remove(i)
                for j, target in link.items():
                    if target == i:
                        link[j] = assigned[j] = link[i]
    rows = spark.createDataFrame([(i, a, b, n, pointers[i]) for n, (i, a, b) in enumerate(points)], "id string, lat double, lng double, ord long, donor string")
    cands = spark.createDataFrame([(j, *place[j], ids.index(j), int(j)) for j in ids], "peer_id string, peer_lat double, peer_lng double, rank long, ord long")
    assert {r.id: r.donor_id for r in D.assign_donors(rows, cands, 300.0).collect()} == assigned


@pytest.mark.parametrize("seed", range(3))
def test_growing_estimate_equals_its_replay(spark, seed):
    rng = random.Random(10 + seed)
    points = scattered(rng, 70)
    pointers = {p[0]: "9" if rng.random() < 0.1 else None for p in points}
    callers, want = [], {}
    for i, lat, lng in points:
        reuse = pointers[i] is not None or (lat is not None and any(metres(lat, lng, *q) <= 300 for q in callers))
        want[i] = not reuse
        if not reuse and lat is not None:
            callers.append((lat, lng))
    rows = spark.createDataFrame([(i, a, b, n, pointers[i]) for n, (i, a, b) in enumerate(points)], "id string, lat double, lng double, ord long, donor string")
    assert {r.id: r.calls for r in D.estimate_growing(rows, 300.0).collect()} == want


def test_fill_rates_count_presence(spark):
    rows = spark.createDataFrame([(0, "", []), (None, "a", ["x"])], "n long, s string, l array<string>")
    assert {r.column: r.rate for r in A.fill_rates(rows, ["n", "s", "l"]).collect()} == {"n": 0.5, "s": 0.5, "l": 0.5}


def test_rollup_ties_and_unknown_costs(spark):
    rows = [("a", 1, 2, "tak", "alvorlig", 10000, 50000, "takst"), ("a", 2, 3, "bad", "alvorlig", 20000, 60000, "estimat"), ("b", 1, 2, "vegg", "mindre", None, None, None)]
    found = spark.createDataFrame(rows, "id string, pos int, tg int, bygningsdel string, alvorlighet string, kostnad_lav long, kostnad_hoy long, kostnad_kilde string")
    got = {r.id: r for r in A.rollup_findings(found).collect()}
    assert (got["a"].est, got["a"].kilde, got["a"].verste) == (70000, "blandet", "bad") and got["b"].est is None


def test_upsert_touches_only_what_changed(spark):
    base = spark.sql("SELECT * FROM VALUES ('1', 5L, true, TIMESTAMP'2020-01-01'), ('2', 6L, false, TIMESTAMP'2020-01-01') t(id, pris, active, updated_at)")
    now = F.lit("2021-01-01").cast("timestamp")
    got = {r.id: r for r in M.upsert_listings(base, spark.createDataFrame([("1", 5), ("2", 6), ("3", 7)], "id string, pris long"), ["pris"], now).collect()}
    assert [got[i].outcome for i in "123"] == ["same", "updated", "inserted"] and all(got[i].active for i in "123")
    assert got["1"].updated_at.year == 2020 and got["2"].updated_at.year == 2021


def test_upsert_marks_what_came_and_what_was_active(spark):
    """With these marks the nightly merge meets the table once a night, with no further joins."""
    base = spark.sql("SELECT * FROM VALUES ('1', 5L, true, TIMESTAMP'2020-01-01'), ('2', 6L, false, TIMESTAMP'2020-01-01') t(id, pris, active, updated_at)")
    got = {r.id: r for r in M.upsert_listings(base, spark.createDataFrame([("2", 6), ("3", 7)], "id string, pris long"), ["pris"], F.lit("2021-01-01").cast("timestamp"), marks=True).collect()}
    assert {i: (r.came, r.was_active, r.active) for i, r in got.items()} == {"1": (False, True, True), "2": (True, False, True), "3": (True, False, True)}


def test_merge_rules(spark):
    base = spark.createDataFrame([("1", 1, 1, 1)], "id string, a long, b long, c long")
    new = spark.createDataFrame([("1", None, 2, None), ("2", 3, 3, 3)], "id string, a long, b long, c long")
    got = {r.id: tuple(r)[1:] for r in M.merge_by_rules(base, new, {"a": "fill", "b": "first", "c": "set"}).collect()}
    assert got == {"1": (1, 1, None), "2": (3, 3, 3)}


def test_geocode_passes(spark):
    rows = [("1", "x", 1, "NO", "1111", "2222", True, True, "main"), ("1", "y", 2, "NO", "2233", "2222", True, True, "main"), ("2", "z", 1, "SE", "1", None, True, True, "main")]
    got = P.choose_geocode(spark.createDataFrame(rows, "id string, candidate string, rank int, country string, postcode string, wanted string, street_level boolean, precise boolean, search string")).collect()
    assert [(r.id, r.candidate, r["pass"]) for r in got] == [("1", "y", 2)]


def test_embedded_json(spark):
    html = '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Other"},{"@type":"Home","price":5}]</script>'
    got = L.json_ld(spark.createDataFrame([("1", html), ("2", "none")], "id string, html string"), "Home").collect()
    assert [(r.id, '"price":5' in r.entry) for r in got] == [("1", True)]


def test_publish_all_reports_a_failure():
    def write(name, _):
        if name == "b":
            raise ValueError("no")
    assert B.publish_all({n: (lambda: None) for n in "abc"}, write) == {"done": ["a"], "failed": ["b", "no"], "untried": ["c"]}
