"""Reading landed pages: corpus scan, snapshots, links, embedded JSON, text sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listaro.functions import scalars as S

BLOCK_TAGS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|footer|nav|header)\b[^>]*>"


def read_pages(files: DataFrame) -> DataFrame:
    """(id, url, html, state) of files (path, content): the id is the last digits of the name; state is ok, blank or unreadable (no UTF-8), whose html is null."""
    text = F.col("content").cast("string")
    readable = F.is_valid_utf8(text)
    blank = F.trim(F.regexp_replace(F.when(readable, text), r"\s+", "")) == ""
    state = F.when(~readable, "unreadable").when(blank | F.col("content").isNull(), "blank").otherwise("ok")
    return files.select(S.last_digits(F.regexp_extract("path", r"([^/]*)$", 1)).alias("id"), F.col("path").alias("url"), F.when(readable, text).alias("html"), state.alias("state"))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a folder with one file each, see ``read_pages``. Files that are gone or can't be read while the job runs are left out, and so count as missing; so do files of no bytes, which the reader skips."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").load(path)
    return read_pages(files.select("path", "content"))


def scan_report(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts of wanted ids, and of those that are missing, blank and unreadable; an id that has several files counts by its best one."""
    rank = F.array_position(F.array(F.lit("ok"), F.lit("blank"), F.lit("unreadable")), F.col("state"))
    best = pages.groupBy("id").agg(F.min_by("state", rank).alias("state"))
    joined = wanted.join(best, "id", "left")
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return joined.agg(F.count("*").alias("wanted"), F.count_if(F.col("state").isNull()).alias("missing"), count("blank"), count("unreadable"))


def append_changed(pages: DataFrame, latest: DataFrame) -> DataFrame:
    """Pages that differ from the latest stored version (id, sha), with their hash."""
    hashed = pages.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    return hashed.join(latest.select("id", F.col("sha").alias("old_sha")), "id", "left").filter(~F.col("sha").eqNullSafe(F.col("old_sha"))).drop("old_sha")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def extract_links(pages: DataFrame, base: str, pattern: str) -> DataFrame:
    """(link_id, url): links that match, made absolute; of a link id's addresses the first in order."""
    found = pages.select(F.explode(hrefs(F.col("html"))).alias("href"))
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), "href")).otherwise(F.col("href"))
    return found.select(url.alias("url")).filter(F.col("url").rlike(pattern)).withColumn("link_id", F.lower(F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1))).groupBy("link_id").agg(F.min("url").alias("url"))


def canonical_links(pages: DataFrame, prefix: str) -> DataFrame:
    """Distinct canonical paths of links below a prefix."""
    found = pages.select(F.explode(hrefs(F.col("html"))).alias("href"))
    return found.select(S.canonical_url("href").alias("url")).filter(F.col("url").startswith(prefix)).distinct()


def merge_result_pages(links: DataFrame) -> DataFrame:
    """Links (page, link) of consecutive result pages: each link at its first page, up to the first page without links.

    Pages are few, so finding the first gap takes one row per page.
    """
    by_page = links.groupBy("page").agg(F.count("link").alias("n"))
    stop = by_page.filter("n = 0").agg(F.min("page").alias("stop"))
    # One row.
    kept = links.filter("link is not null").join(F.broadcast(stop), F.col("stop").isNull() | (F.col("page") < F.col("stop")))
    return kept.groupBy("link").agg(F.min("page").alias("page"))


def json_ld(pages: DataFrame, kind: str) -> DataFrame:
    """(id, entry) for the first embedded JSON-LD object of a type, also inside a list; broken blocks are passed over."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select("id", F.posexplode(blocks).alias("block", "json"))
    parsed = rows.select("id", "block", F.try_parse_json("json").alias("v"))
    single = parsed.select("id", "block", F.lit(-1).alias("pos"), "v")
    listed = parsed.select("id", "block", F.expr("try_variant_get(v, '$', 'array<variant>')").alias("vs")).filter("vs is not null").select("id", "block", F.posexplode("vs").alias("pos", "v"))
    typed = single.unionByName(listed).filter(F.expr("try_variant_get(v, '$.@type', 'string')") == kind)
    return typed.groupBy("id").agg(F.min_by(F.to_json("v"), F.struct("block", "pos")).alias("entry"))


def page_text(html: Column) -> Column:
    """Readable text: scripts and styles go, block tags end lines, other tags leave a space, blank runs shrink."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(F.regexp_replace(bare, BLOCK_TAGS, "\n"), r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        lines = F.replace(lines, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def text_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, heading, body): a section per line; the heading is what stands before the first full stop."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    return lines.select("id", "pos", F.substring_index("line", ".", 1).alias("heading"), F.trim(F.expr("substring(line, length(substring_index(line, '.', 1)) + 2)")).alias("body"))
