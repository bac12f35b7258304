"""Web archives: round trips, revisits and the merged index against plain Python."""

import base64
import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from listaro.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, date long, archive string, place int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "a", 2) for r in rows], SCHEMA)


ODD = [
    (1, "http://a.example.com/x?b=2&a=1", "<p>one</p>"), (2, "https://www.a.example.com/x?a=1&b=2#top", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://[bad", "é日本 👍"),
    (6, "http://a.example.com/x\r\nWARC-Type: revisit", "two\r\n\r\nlines\r\n\r\n"), (7, "http://ü.example/ö%20", "x" * 300_000), (None, "http://b.example/", "<p>one</p>"), (None, "http://b.example/", "alone"),
    (9, "not a url", "WARC/1.1\r\n\r\n"), (10, "http://a.example.com:8080/x", ""), (10, "http://a.example.com:8080/x", ""), (1, "http://b.example/", "other"), (10**17, "http://z.example", "far"),
]


def want(rows, least=0):
    payload = [(i, (html or "").encode()) for i, _, html in rows]
    kept = {}
    for i, p in payload:
        kept[p] = max(kept.get(p, -1), -1 if i is None else i)
    out = []
    for i, p in payload:
        first = None if kept[p] == -1 else kept[p]
        revisit = len(p) >= least and i != first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 8])
def test_captures_match_brute_force(spark, least):
    index = warc.merged_index(warc.write_archives(pages(spark, ODD), least=least))
    got = [tuple(r) for r in index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert collections.Counter(got) == collections.Counter(want(ODD, least))


def test_one_page_and_none(spark):
    assert warc.merged_index(warc.write_archives(pages(spark, []))).count() == 0
    rows = warc.merged_index(warc.write_archives(pages(spark, ODD[:1]))).collect()
    assert [(r.place, r.visit, r.url_key) for r in rows] == [(0, 1, "com,example,a)/x?a=1&b=2")]


def test_histories_are_in_global_order(spark, monkeypatch):
    """A URL with a third of all captures goes over many ranges; its visits are counted on."""
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 40)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    r = random.Random(4)
    rows = [(i, "http://hot.example/p" if r.random() < 0.34 else f"http://{r.choice('abc')}.example/{r.randrange(60)}", f"<p>{r.randrange(50)}</p>") for i in range(1500)]
    times = {i: r.randrange(10**6) for i, _, _ in rows}
    docs = spark.createDataFrame([(*row, times[row[0]]) for row in rows], "page_id long, url string, html string, t long").withColumn("t", F.timestamp_seconds("t")).repartition(5)
    got = warc.merged_index(warc.write_archives(docs, date_col="t")).orderBy("place").collect()
    order = sorted((warc.url_key(url), times[i], i) for i, url, _ in rows)
    assert [(g.url_key, g.page_id) for g in got] == [(k, i) for k, _, i in order]
    assert [g.place for g in got] == list(range(1500))
    seen = collections.Counter()
    for g in got:
        seen[g.url_key] += 1
        assert g.visit == seen[g.url_key]


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree_merges_in_order_and_stably(k):
    r = random.Random(k)
    lists = [sorted([(r.randrange(9), j) for _ in range(r.randrange(12))]) for j in range(k)]
    assert list(warc.LoserTree(lists, key=lambda x: x[0])) == sorted((x for rows in lists for x in rows), key=lambda x: (x[0], x[1]))
    assert list(warc.LoserTree([])) == []


def test_records_are_plain_gzip_members_and_damage_shows(spark):
    archives = warc.write_archives(pages(spark, ODD)).collect()
    data = max((bytes(r.data) for r in archives), key=len)
    found = list(warc.records(data))
    for offset, length, headers, block in found:
        text = zlib.decompress(data[offset : offset + length], 31)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(block + b"\r\n\r\n") and int(headers["Content-Length"]) == len(block)
    for broken in (data[:-3], data[:40] + bytes([data[40] ^ 255]) + data[41:], data + b"x"):
        with pytest.raises(ValueError):
            [warc._entry(h, b) for _, _, h, b in warc.records(broken)]


def test_url_keys():
    assert warc.url_key("HTTP://WWW.A.Example.com:80/X/") == warc.url_key("https://a.example.com/x#top") == "com,example,a)/x"
    assert warc.url_key("http://a.example/?b&a=1") == "example,a)/?a=1&b"
    assert warc.url_key("http://[bad") == "http://[bad"
    assert warc.url_key("") == ")/"
