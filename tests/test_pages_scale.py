"""Page fields work their parts out once, in as many tasks as the session has; sentences behind unfinished documents."""

import duckdb

from listaro.operators import parsing as P
from listaro.plans import pages, rest
from listaro.plans.bindings import bound

F = P.F


def test_shared_parts_are_worked_out_once(spark):
    page = spark.createDataFrame([('<script id="advertising-initial-state">{"config":{"adServer":{"gam":{"targeting":[{"key":"a","value":["1"]},{"key":"b","value":["2"]},{"key":"a","value":["3"]}]}}}}</script>',)], "html string")
    found = page.select(P.targeting_map(F.col("html")).alias("t"))
    assert found.first().t == {"a": ["3"], "b": ["2"]}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("<script") == 1


def test_pages_are_made_in_all_tasks(spark):
    assert "listing_pages" in pages.BINDINGS
    for name in ("listing_pages", "ad_pages"):
        assert bound(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_unfinished_last_sentences(spark, tmp_path):
    texts = [(i, t) for i, t in enumerate(["th ingen", "uten", "er kom ikke", "se punkt", "garanti", None, "egen", "styre", "ikke tillatt"] * 18)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, query in (("certificates", rest.certificates), ("prose_rules", rest.prose_rules)):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(duckdb.sql(rest.SQL[name]).fetchall())


def test_pages_are_read_in_one_pass(spark):
    frame = bound(spark, "/root/testdata/sf0.001", "listing_pages")
    for read in (P.listing_fields, P.detail_fields):
        plan = read(frame)._jdf.queryExecution().optimizedPlan().toString()
        # No expression works through all tags of a page; the page's text meets one pass, and no step behind it.
        assert (plan.count("MapInArrow"), plan.count("aggregate(")) == (1, 0)
        assert "html" not in plan.split("MapInArrow")[0]


def test_blocks_of_odd_pages(spark):
    page = "<p a='<div>no</div>'><!-- <i data-testid=local-area-name>no</i> --><div data-testid='object-facilities'><DIV>A &amp; B</DIV><div title='</div>'>C</div ></div>D<span data-testid=local-area-name>x<span>y</span>z</span>w<dd>"
    got = P.detail_fields(spark.createDataFrame([("1", page + "<div data-testid=info-ownership-type><dd>Eier</p>rest")], "id string, html string")).first()
    assert (got.facilities, got.nabolag, got.eieform) == (["A & B", "C"], "xyz", "Eier")
