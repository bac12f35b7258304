"""The look-up's pruning, and a scanned folder with files of all kinds."""

from pyspark.sql import functions as F

from listaro.operators import payload as Y
from listaro.sources import pages as G


def test_detail_reads_only_its_parts(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") * 2).alias("pris")).unionByName(spark.createDataFrame([("b:é", 1)], "id string, pris long"))
    Y.write_payload(rows, str(tmp_path / "p"), parts=16)
    found = Y.detail(spark, str(tmp_path / "p"), ["7", "499", "b:é", "none"], parts=16)
    assert sorted((r.id, r.pris) for r in found.collect()) == [("499", 998), ("7", 14), ("b:é", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "part" in filters[: filters.index("]") + 1] and "PushedFilters: [In(id" in plan
    assert Y.detail(spark, str(tmp_path / "p"), [], parts=16).count() == 0


def test_scan_counts_missing_blank_and_unreadable_files(spark, tmp_path):
    for name, content in {"ad-1.html": b"<p>one</p>", "ad-2.html": b" \n\t", "ad-3.html": b"\xff\xfe\xc3(", "ad-4.html": b"\n", "deep/ad-5.html": "<p>å</p>".encode(), "deep/ad-2.html": b"<p>better</p>"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    pages = G.scan_pages(spark, str(tmp_path))
    assert {(r.id, r.state, r.html) for r in pages.filter("state != 'blank'").collect()} == {("1", "ok", "<p>one</p>"), ("3", "unreadable", None), ("5", "ok", "<p>å</p>"), ("2", "ok", "<p>better</p>")}
    wanted = spark.createDataFrame([(str(i),) for i in range(1, 8)], "id string")
    assert G.scan_report(wanted, pages).first().asDict() == {"wanted": 7, "missing": 2, "blank": 1, "unreadable": 1}


def test_files_that_go_while_the_job_runs_are_missing(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"ad-{i}.html").write_bytes(b"<p>x</p>")
    pages = G.scan_pages(spark, str(tmp_path))
    (tmp_path / "ad-1.html").unlink()
    assert G.scan_report(spark.createDataFrame([("0",), ("1",), ("2",)], "id string"), pages).first().missing == 1


def test_the_payload_meets_its_children_once(spark):
    """Both buckets of the first source come from one join: findings are read for their roll-up, their list and the facilities, each once."""
    from listaro.plans import payloads

    rows = payloads.full_payload(spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("l_linestatus") > 0
    reads = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation [l_orderkey" in line]
    assert len(reads) == 3
    assert {r.bucket for r in rows.select("bucket").distinct().collect()} == {"active", "closed", "b"}
