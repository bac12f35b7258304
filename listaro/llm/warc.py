"""Web archives of captured pages, and their index in global order by external merge.

Writing: a payload that several captures share is kept once, by the capture with
the largest id; the others become revisit records that name it. Only digests and
ids are grouped for that. Archives are rows of a table with one binary each, made
of gzipped WARC/1.1 records, so a lost task is simply written again.

Reading: each archive is a capture run. A task reads its records back, checks
their digests and sorts the run's entries by URL key and time. The runs are dealt
by ranges of (URL key, time, id), so one URL with a third of all captures is cut
like any other, and within a range the slices of all runs, each in order, are
merged by a loser tree. Payloads are never in that merge: only index entries are.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.staging import drop_stage, read_table, shuffle_width, stage

#: Bytes of an archive, a record more or less; payloads are compressed at a level that favours speed.
ARCHIVE_BYTES, LEVEL = 16 << 20, 1
#: Index entries of a range, about: what one task merges in memory.
RANGE_ENTRIES = 100_000
#: Bytes of an archive that are unpacked at a time.
READ_BYTES = 1 << 14
#: Rows that are in a Python worker at once.
ROWS = 500
#: From 1970 to the last second of the year 9999.
SECONDS = 253_402_300_800
EPOCH = datetime.datetime(1970, 1, 1)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "url_key string, captured_at string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, archive bigint, offset bigint, length bigint"
PLACED = f"{ENTRY}, range_no int, within bigint, seen bigint"
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


def url_key(url: str) -> str:
    """The URL in the order of its host's labels from the right, lower-case, without scheme, 'www.', default port and fragment; queries sorted."""
    text = url.strip()
    try:
        parts = urlsplit(text if "://" in text else f"//{text}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return text.lower()
    port = f":{port}" if port not in (None, 80, 443) else ""
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower().rstrip('/') or '/'}{'?' + query if query else ''}"


def _uri(url: str) -> str:
    """A header's value: white space, control and other characters that may not stand in a URI are escaped."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the response's headers alone; their Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record; ValueError on damage."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        member, data, end = zlib.decompressobj(31), [], at
        try:
            while end < len(view) and not member.eof:
                data.append(member.decompress(view[end : end + READ_BYTES]))
                end += len(view[end : end + READ_BYTES])
        except zlib.error as e:
            raise ValueError(f"damaged record at {at}") from e
        end -= len(member.unused_data)
        head, mark, rest = b"".join(data).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers.get("Content-Length", -1))
        if not member.eof or not mark or lines[0] != "WARC/1.1" or len(rest) != size + 4:
            raise ValueError(f"damaged record at {at}")
        yield at, end - at, headers, rest[:size]
        at = end


def _entry(headers: dict[str, str], block: bytes) -> tuple:
    """What the index keeps of a record; a response's digest is worked out again from its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit, digest = headers["WARC-Type"] == "revisit", headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(head.decode().rpartition("Content-Length: ")[2])
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    url = headers.get("WARC-Target-URI")
    return (url_key(url or ""), headers["WARC-Date"], _page_id(headers["WARC-Record-ID"]), url, headers["WARC-Type"], size, digest, _page_id(headers["WARC-Refers-To"]) if revisit else None)


def _order(entry: tuple) -> tuple:
    """URL key, time, id; an entry without an id comes first."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


class LoserTree:
    """The least head of k ordered lists, each step at the cost of one path from a leaf to the root.

    Inner node i holds the loser of the match between its subtrees' winners; node 0 holds the winner of all.
    """

    def __init__(self, lists: list[list], key=_order):
        self.lists, self.key, self.k = lists, key, len(lists)
        self.at = [0] * self.k
        self.heads = [key(x[0]) if x else None for x in lists]
        self.tree = [0] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for i in range(self.k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.tree[i] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Ended lists lose; of equal heads the one of the first list wins, so the merge is stable."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def __iter__(self) -> Iterator:
        while self.k:
            winner = self.tree[0]
            if self.heads[winner] is None:
                return
            yield self.lists[winner][self.at[winner]]
            self.at[winner] += 1
            rows = self.lists[winner]
            self.heads[winner] = self.key(rows[self.at[winner]]) if self.at[winner] < len(rows) else None
            i = (winner + self.k) // 2
            while i:
                if self._before(self.tree[i], winner):
                    self.tree[i], winner = winner, self.tree[i]
                i //= 2
            self.tree[0] = winner


def _captures(pages: DataFrame, id_col: str, url_col: str, html_col: str, date_col: str | None) -> DataFrame:
    """(page_id, url, html, date): the html in UTF-8, null as empty; the time in microseconds since 1970.

    Where no column has the time of capture, pages are in the order of their ids, a second apart.
    """
    date = F.unix_micros(F.col(f"`{date_col}`").cast("timestamp")) if date_col else F.pmod(F.col(f"`{id_col}`").cast("long"), F.lit(SECONDS)) * 1_000_000
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("html"), F.coalesce(date, F.lit(0)).alias("date"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, least: int = 0) -> DataFrame:
    """Write a WARC record per row; returns a reader of the archives: (archive long, data binary).

    Of equal payloads of at least ``least`` bytes the capture with the largest id is a response, the others revisit it.

    Defined cases: null html is an empty payload; a null id is smaller than any; rows that repeat both the id and the payload
    of a response are responses too; a null url has no URI and an empty key; characters that may not stand in a URI are
    escaped; a null time is 1970; an empty table gives no archives; very long pages only make long records; other columns
    are not looked at, whatever their names.
    """
    rows = _captures(pages, id_col, url_col, html_col, date_col)
    digests = rows.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("size")).filter(F.col("size") >= least)
    # A hot payload is one row per task before the shuffle; payloads that stand alone need no look-up.
    shared = digests.groupBy("sha").agg(F.max("page_id").alias("kept_by"), F.count("*").alias("n")).filter("n > 1").select("sha", "kept_by")
    shared = stage(shared, "warc-shared")
    known = rows.withColumn("sha", F.sha2("html", 256)).join(shared.withColumn("again", F.lit(True)), "sha", "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("kept_by"))
    archives = stage(known.select("page_id", "url", "html", "date", F.col("kept_by"), revisit.alias("revisit")).mapInArrow(_write, "archive bigint, data binary"), "warc-archives", rebalance=False)
    drop_stage(shared)
    return archives


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, parts, held = TaskContext.get().partitionId() << 32, [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"".join(parts)], pa.binary())], ["archive", "data"])
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for page_id, url, html, date, kept_by, revisit in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                stamp = (EPOCH + datetime.timedelta(microseconds=date)).isoformat(timespec="microseconds") + "Z"
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                parts.append(packer.compress(record(page_id, url, stamp, html, kept_by, revisit)) + packer.flush())
                held += len(parts[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    number, held = number + 1, 0
                    parts.clear()
    if parts:
        yield flush()


def capture_runs(archives: DataFrame) -> DataFrame:
    """The archives' index entries, read back from the records; each archive's are in order of (URL key, time, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = sorted(((*_entry(headers, block), number, offset, length) for offset, length, headers, block in records(data.as_buffer())), key=_order)
                yield _batch(rows, ENTRY)

    return archives.select("archive", "data").mapInArrow(run, ENTRY)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's slices of the runs, each in order, merged into one."""
    slices: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            slices.setdefault(row[8], []).append(row)
    for rows in slices.values():
        rows.sort(key=_order)  # in order as they were written; the shuffle may have brought a run's blocks in another order
    merged, range_no, place, key, seen = [], TaskContext.get().partitionId(), 0, None, 0
    for row in LoserTree([slices[k] for k in sorted(slices)]):
        seen = seen + 1 if row[0] == key else 1
        key = row[0]
        merged.append((*row, range_no, place, seen))
        place += 1
        if len(merged) == 10_000:
            yield _batch(merged, PLACED)
            merged = []
    if merged:
        yield _batch(merged, PLACED)


def merged_index(archives: DataFrame) -> DataFrame:
    """Every capture in global order: the entries of ``capture_runs`` with ``place`` (from 0) and ``visit`` (from 1, within the URL key's history).

    The cases are those of ``write_archives``; captures of equal key, time and id are in the order of their archives.
    """
    spark = archives.sparkSession
    runs = stage(capture_runs(archives), "warc-runs", rebalance=False)
    ranges = max(shuffle_width(spark), runs.count() // RANGE_ENTRIES + 1)
    ordered = runs.repartitionByRange(ranges, "url_key", "captured_at", F.asc_nulls_first("page_id"), "archive", "offset")
    index = stage(ordered.mapInArrow(_merge, PLACED), "warc-index", rebalance=False)
    drop_stage(runs)
    # One row per range comes to the driver: how many entries it has, and how its first and its last history go on.
    ends = index.groupBy("range_no").agg(F.count("*").alias("n"), F.min_by("url_key", "within").alias("first"), F.max_by(F.struct("url_key", "seen"), "within").alias("last"))
    before, key, seen, carried = 0, None, 0, []
    for r in ends.orderBy("range_no").collect():
        more = seen if r.first == key else 0
        carried.append((r.range_no, before, r.first, more))
        before, key, seen = before + r.n, r.last.url_key, r.last.seen + (more if r.last.url_key == r.first else 0)
    offsets = F.broadcast(spark.createDataFrame(carried, "range_no int, before bigint, first string, more bigint"))
    visit = F.col("seen") + F.when(F.col("url_key") == F.col("first"), F.col("more")).otherwise(0)
    return index.join(offsets, "range_no").select((F.col("before") + F.col("within")).alias("place"), visit.alias("visit"), *COLUMNS)


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's capture, read back from the archives; the cases are defined as in ``write_archives``."""
    index = merged_index(write_archives(read_table(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1: eight groups of five hexadecimal digits, four letters each.
OP11_SQL = """
WITH digests AS MATERIALIZED (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
kept AS (SELECT payload, max(page_id) AS kept_by FROM digests GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = kept_by THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept_by THEN kept_by END AS refers_to
FROM digests JOIN kept USING (payload)
"""
