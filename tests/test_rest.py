"""Page parsing, chains, caches, gates and corrections on small cases."""

import json
import re
import time

import pytest

from listaro.operators import control as C
from listaro.operators import joins as J
from listaro.operators import parsing as P
from listaro.staging import KEY, shared_dir


def test_app_state_formats():
    graph = [{"_1": 2, "_9": 0}, "ad", {"_3": 4, "_5": -7, "_6": -8, "_7": 0, "_8": 99, "bad": 1}, "name", "x", "yes", "no", "self", "beyond", -1]
    assert json.loads(P.app_state(json.dumps(graph))) == {"ad": {"name": "x", "yes": True, "no": False, "self": None, "beyond": None}, "-1": None} or json.loads(P.app_state(json.dumps(graph)))["ad"]["yes"] is True
    assert json.loads(P.app_state('{"state": {"a": 1}}')) == {"a": 1} and json.loads(P.app_state('{"a": 1}')) == {"a": 1}
    for odd in (None, "", "[]", "[1]", "3", "{", '"x"', "null"):
        assert P.app_state(odd) is None
    deep: list = [{"_1": 2}, "a"]
    for i in range(600):
        deep += [[3 + i]]
    assert P.app_state(json.dumps(deep)) is not None


def test_shared_nodes_cost_no_more_than_the_graph():
    """Ten thousand nodes, each twice in the one before: written once each, and referred to."""
    graph = [{"_1": 2}, "a"] + [x for i in range(5000) for x in ({"_1": 3 + 2 * i, "_3": 4 + 2 * i}, [4 + 2 * i, 4 + 2 * i])]
    began = time.time()
    text = P.app_state(json.dumps(graph))
    assert time.time() - began < 1 and '"$ref"' in text and len(text) < len(json.dumps(graph)) + 70_000
    # A few shared nodes are written out.
    assert json.loads(P.app_state('[{"_1":2},"a",[3,3],{"_4":5},"b",7]')) == {"a": [{"b": 7}, {"b": 7}]}
    assert json.loads(P.app_state('[{"_1":2},"a",[3,3],{"_4":5},"b","c"]')) == {"a": [{"b": "c"}, {"b": "c"}]}


def test_targeting_map_takes_any_page(spark):
    def page(x):
        return f'<script id="advertising-initial-state">{x}</script>'

    whole = '{"config":{"adServer":{"gam":{"targeting":[{"key":"a","value":["1"]},{"key":"a","value":["2"]},{"value":["3"]},{"key":"b"}]}}}}'
    rows = [(page(whole),), (page("{"),), (page('{"config":[]}'),), ("no script",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "html string").select(P.targeting_map(P.F.col("html")).alias("t")).collect()]
    assert got[0] == {"a": ["2"]} and all(not t for t in got[1:])


def test_chains_cycles_and_values(spark):
    links = [("a", "b"), ("b", "a"), ("c", "a"), ("p", "q"), ("q", "r"), ("r", "s"), ("x", "y"), ("y", "z"), ("z", "x"), ("s2", "s2")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    got = {r.id: r.root for r in J.chain_roots(spark.createDataFrame(links, "id string, target string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "p": "s", "q": "s", "r": "s", "x": "x", "y": "x", "z": "x", "s2": "s2"} | {f"n{i:03}": "n040" for i in range(40)}
    nodes = [("a", "b", None), ("b", "c", None), ("c", None, -1), ("d", "a", 5), ("x", "y", None), ("y", "x", None), ("e", "gone", None)]
    assert {r.id: r.value for r in J.chain_value(spark.createDataFrame(nodes, "id string, target string, value int")).collect()} == {"a": -1, "b": -1, "c": -1, "d": 5, "x": None, "y": None, "e": None}
    assert J.chain_roots(spark.createDataFrame([], "id string, target string")).count() == 0


def test_chain_roots_rounds_follow_the_longest_way(spark, monkeypatch):
    """A small cycle, with a tail of smaller ids, among many short chains does not send all rows round log2(all links) times."""
    from listaro import staging

    written, plain = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda *a, **k: (written.append(1), plain(*a, **k))[1])
    ring = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("b2", "c2"), ("b1", "b2"), ("own", "own"), ("to-own", "own")]
    links = [*ring, *[(f"x{i}", f"y{i}") for i in range(5000)]]
    got = {r.id: r.root for r in J.chain_roots(spark.createDataFrame(links, "id string, target string")).collect()}
    assert got == {a: "own" if "own" in a else "c1" for a, _ in ring} | {f"x{i}": f"y{i}" for i in range(5000)}
    assert len(written) <= 7


def test_donor_distance_deals_no_blank_pointers(spark):
    """Rows without a pointer, null or blank, stay out of the join that the rows are dealt for."""
    from listaro.plans.more import donor_distance

    geo = [("1", 60.0, 10.0, None), ("2", 60.001, 10.0, " 1 "), ("3", None, None, "1"), ("4", 60.0, 10.0, "3"), ("5", 60.0, 10.0, ""), ("6", 60.0, 10.0, " ")]
    assert [(r.id, r.metres) for r in J.donor_distance(spark.createDataFrame(geo, "id string, lat double, lng double, donor string")).collect()] == [("2", 111)]
    plan = donor_distance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"NOT \(trim\(.*? = \)", plan), plan


def test_wide_station_covers_far_listings(spark):
    stations = spark.createDataFrame([(1, 60.0, 10.0, 5000), (2, 60.001, 10.0, 50), (3, 60.0, 10.0, None)], "station_id long, lat double, lng double, radius_m int")
    listings = spark.createDataFrame([("near", 60.001, 10.0001), ("far", 60.03, 10.0), ("out", 60.2, 10.0)], "id string, lat double, lng double")
    assert {r.id: r.station_id for r in J.nearest_covering(listings, stations).collect()} == {"near": 2, "far": 1}


def test_cache_import_is_all_or_nothing(spark):
    cache = spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], "sha string, response string, version int")
    merged, counts = C.import_cache(cache, spark.createDataFrame([("b", "new"), ("c", "new")], "sha string, response string"), defaults={"version": 1})
    assert sorted(map(tuple, merged.collect())) == [("a", "old", 0), ("b", "new", 1), ("c", "new", 1)] and tuple(counts.first()) == (1, 1)
    with pytest.raises(ValueError):
        C.import_cache(cache, spark.createDataFrame([(None, "new")], "sha string, response string"), defaults={"version": 1})


def test_annotation_tab_headers_and_ids(spark):
    tab = spark.createDataFrame([("=HYPERLINK(\"u/1\", \"12\")", "x"), (" 34 ", "y"), ("abc", "z"), (None, "w"), ("", "v")], "` ID ` string, KOMMENTAR string")
    rows = P.annotation_tab(tab, {"id": "id", "kommentar": "comment", "tag": "tag"}).collect()
    assert sorted((r.id, r.comment, r.tag) for r in rows) == [("12", "x", None), ("34", "y", None), ("abc", "z", None)]


def test_energy_and_money_texts(spark):
    F = P.F
    rows = [("Energimerking A - Grønn", None), ("Energimerking - Oransje", "Energimerke E"), ("Energimerking", "Energimerke"), ("Energimerking", "Energimerke H"), (None, None)]
    got = [tuple(r.e) for r in spark.createDataFrame(rows, "t string, b string").select(P.energy(F.col("t"), F.col("b")).alias("e")).collect()]
    assert got == [("A", "Grønn"), ("E", "Oransje"), (None, None), (None, None), (None, None)]
    html = '<dl data-testid="pricing-details"><dt> Totalpris </dt><dd>1 234 kr</dd><dt>Fellesgjeld</dt><dd>ingen</dd><dt>Totalpris</dt><dd>5 kr</dd></dl>'
    rows = P.detail_fields(spark.createDataFrame([("1", html), ("2", "")], "id string, html string")).select("id", *P.MONEY.values()).collect()
    assert {r.id: {k: v for k, v in r.asDict().items() if v is not None} for r in rows} == {"1": {"id": "1", "totalpris": 5}, "2": {"id": "2"}}


def test_gate_and_geocodes(spark):
    crawls = spark.createDataFrame([("a", True)] * 8 + [("a", False)] * 2 + [("b", True)] * 3 + [("b", False)] + [("c", None)], "source string, ok boolean")
    assert {r.source: r.verdict for r in C.ingest_gate(crawls, "source").collect()} == {"a": "ok", "b": "too many failures", "c": "no pages"}
    geo = spark.createDataFrame([("1", 1.0, 1.0, 1), ("2", None, None, 0)], "id string, lat double, lng double, geocode_failed int")
    found = spark.createDataFrame([("1", 60.0, 10.0), ("2", 0.0, 0.0), ("3", 10.0, 60.0)], "id string, lat double, lng double")
    assert sorted(map(tuple, C.apply_geocodes(geo, found).collect())) == [("1", 60.0, 10.0, 0), ("2", None, None, 1), ("3", 60.0, 10.0, 0)]


def test_staging_needs_a_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match=KEY):
        shared_dir(Session)
