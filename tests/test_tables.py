"""Stated bands, areas, places and medians on small cases."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from listaro.operators import aggregates as A
from listaro.operators import areas as R
from listaro.operators import bands as B
from listaro.operators import places as L


def test_bands_by_place_and_snapped_outward(spark):
    texts = [
        "Taket: kostnadsestimat kr 12 000 - kr 48 000, se under. Prisanslag: over 700.000.", "Utbedringskostnaden gjelder er: under 9 999 kr", "kostnadsoverslag 10000 til 20000", "Prisanslag 50 000 – 20 000",
        "Kostnadsestimat: 500", "Solgt for 900 000 - 950 000", "", None, "Estimert kostnad 1 000 000 - 3 000 000\nog kostnadsestimat: 1000 - 1000",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in rows.select("i", B.stated_bands(F.col("t")).alias("b"), B.without_stated(F.col("t")).alias("rest")).collect()}
    assert [[(b.low, b.high) for b in got[i].b] for i in range(len(texts))] == [[(10_000, 50_000), (500_000, 1_000_000)], [(0, 10_000)], [(10_000, 20_000)], [], [], [], [], [], [(1_000_000, 1_000_000), (0, 10_000)]]
    for i, text in enumerate(texts):
        for b in got[i].b:
            assert "kostnad" in text[b.begin : b.end].lower() or "prisanslag" in text[b.begin : b.end].lower()
    assert (got[0].rest, got[1].rest, got[5].rest, got[7].rest) == ("Taket: , se under. .", " kr", texts[5], None)


def test_band_report_pairs_by_middles(spark):
    schema = "r string, low long, high long"
    stated = spark.createDataFrame([("a", 0, 10_000), ("a", 50_000, 100_000), ("b", 0, 10_000), ("c", 10_000, 20_000)], schema)
    model = spark.createDataFrame([("a", 100_000, 200_000), ("a", 0, 10_000), ("b", 50_000, 100_000), ("b", 0, 10_000), ("d", 0, 10_000)], schema)
    assert B.band_report(stated, model, "r").first().asDict() == {"pairs": 3, "exact": 2, "within_one": 3, "higher": 1, "lower": 0, "stated_unmatched": 1, "estimated_unmatched": 2}


def ray(corners, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(corners, corners[-1:] + corners[:-1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / ((y2 - y1) or 1e-12) + x1:
            odd = not odd
    return odd


def test_areas_match_a_ray_for_each_pair(spark):
    r, nan = random.Random(8), float("nan")
    shapes = {}
    for i in range(30):
        x, y, size = r.uniform(-5, 5), r.uniform(-5, 5), 10 ** r.uniform(-1, 0.8)
        shapes[i] = [(x + r.uniform(-size, size), y + r.uniform(-size, size)) for _ in range(r.randrange(3, 9))]
    frame = [(i, [*c[:1], (nan, 1.0), (None, 2.0), (float("inf"), 0.0), *c[1:]]) for i, c in shapes.items()] + [(90, []), (91, [(0.0, 0.0), (1.0, 1.0)]), (92, None)]
    areas = spark.createDataFrame(frame, "area int, corners array<struct<lng:double,lat:double>>")
    points = [(str(i), *shapes[i % 30][0]) if i % 5 == 0 else (str(i), r.uniform(-6, 6), r.uniform(-6, 6)) for i in range(400)]
    odd = [("n1", None, 1.0), ("n2", nan, 1.0), ("n3", 1.0, float("inf"))]
    rows = spark.createDataFrame(points + odd, "id string, lng double, lat double")
    got = sorted(tuple(x) for x in R.in_areas(rows, areas).collect())
    want = sorted((i, a) for i, x, y in points for a, c in shapes.items() if ray(c, x, y))
    assert got == want and len(got) > 30
    none = spark.createDataFrame([], areas.schema)
    assert R.in_areas(rows, none).count() == 0
    held = {i for i, _ in want}
    out = {x.id for x in R.outside(rows.select(F.lit("a").alias("source"), "id", "lng", "lat"), areas).collect()}
    assert out == {i for i, _, _ in points if i not in held}


@pytest.mark.parametrize("hot", [False, True])
def test_places_need_no_task_per_group(spark, hot):
    r = random.Random(1)
    rows = [(None if i % 50 == 0 else "k" if hot else r.choice("abc"), r.choice([None, 1, 2, 3, 4]), i) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(3)
    got = L.placed(frame, ["g"], ["v", "i"])
    parts = got.select("i", "place", "g").collect()
    want = {}
    for g in {g for g, _, _ in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want |= {x[2]: n + 1 for n, x in enumerate(own)}
    assert {p.i: p.place for p in parts} == want
    assert L.placed(frame.limit(0), ["g"], ["v"]).count() == 0 and L.placed(frame.limit(0), [], ["v"]).count() == 0


def test_hot_key_is_dealt_to_many_tasks(spark):
    frame = spark.range(20_000).select(F.lit("k").alias("g"), (F.col("id") * 7919 % 20_011).alias("v"))
    held = L.placed(frame, ["g"], ["v"])
    assert held.agg(F.max("place")).first()[0] == 20_000
    sizes = [r.n for r in frame.repartitionByRange(4, "g", "v").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000


def test_sorted_tables(spark):
    rows = spark.createDataFrame([(1, "Ås"), (2, "zoo"), (3, " ål"), (4, "Bergen"), (5, "bergen"), (6, ""), (7, None), (8, "Øl"), (9, "ærlig"), (10, "élan"), (11, "f")], "id int, t string")
    order = lambda down: [r.id for r in L.sort_table(rows, L.text_key(F.col("t")), down).orderBy("place").collect()]
    assert order(False) == [4, 5, 10, 11, 2, 9, 8, 3, 1, 6, 7]
    assert order(True) == [1, 3, 8, 9, 2, 11, 10, 4, 5, 6, 7]
    ranked = [r.id for r in L.sort_table(rows.withColumn("s", F.element_at(F.array(*map(F.lit, ["b", "A ", "x"])), F.col("id") % 3 + 1)).filter("id < 7"), L.rank_key(F.col("s"), ("a", "b")), False).orderBy("place").collect()]
    assert ranked == [1, 4, 3, 6, 2, 5]


def test_medians_of_hot_and_small_keys(spark):
    r = random.Random(6)
    groups = {"hot": [r.randrange(1000) / 4 for _ in range(801)], "two": [1.0, 4.0], "one": [3.0], "none": [None, None]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {x.k: (x.n, x.median, x.mad) for x in A.median_mad(rows, "k", "v").collect()}
    for k, vs in groups.items():
        known = [v for v in vs if v is not None]
        m = statistics.median(known) if known else None
        assert got[k] == (len(known), m, statistics.median(abs(v - m) for v in known) if known else 0.0)


def test_a_text_is_searched_once_for_its_bands(spark):
    """The search for stated costs, and for a band's amounts, stands once in the expression, not once for each use of what it finds."""
    rows = spark.createDataFrame([("Kostnadsestimat: 20 000 - 50 000",)], "text string").select(B.stated_bands(F.col("text")).alias("b"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("kostnadsoverslag") == 1 and plan.count("regexp_extract_all") == 1
