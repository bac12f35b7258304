"""Facts from prose by ordered rules, and checks of what a classifier returned."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listaro.functions import scalars as S
from listaro.operators import joins as J


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule (pattern, label) that the text has; null if none, or if there is no text."""
    out = F
    for i, (pattern, label) in enumerate(rules):
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, label) if i == 0 else out.when(hit, label)
    return out


def tri_state(text: Column, negative: str, positive: str) -> Column:
    """False where the negative pattern is, else true where the positive one is, else null."""
    return F.when(text.rlike("(?i)" + negative), False).when(text.rlike("(?i)" + positive), True)


def mention(text: Column, pattern: str) -> Column:
    """Whether a text that was read has the pattern; null where none was read."""
    return F.when(text.isNotNull(), text.rlike("(?i)" + pattern))


def amount_near(text: Column, word: str, within: int = 80, most: int = 99_999_999) -> Column:
    """The number that follows a word within so many characters, if it is from 1 to ``most``."""
    digits = F.regexp_replace(F.regexp_extract(text, rf"(?is){word}.{{0,{within}}}?(\d[\d .]*)", 1), r"\D", "")
    n = digits.try_cast("long")
    return F.when(n.between(1, most), n)


def scoped_text(sections: DataFrame, topic: str, dropped: str) -> DataFrame:
    """(id, text): bodies of sections with the topic in their heading, or else all bodies but dropped ones, in order."""
    marked = sections.withColumn("hit", F.col("heading").rlike("(?i)" + topic)).withColumn("out", F.col("heading").rlike("(?i)" + dropped))
    def joined(cond: Column) -> Column:
        return F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "body")))), lambda x: x["body"]))
    return marked.groupBy("id").agg(F.when(F.bool_or("hit"), joined(F.col("hit"))).otherwise(joined(~F.col("out"))).alias("text"))


def classify_input(sections: DataFrame, heading: str, marker: str, least: int = 200) -> DataFrame:
    """(id, text) of sections chosen by heading or marker; null where that is less than ``least`` characters."""
    chosen = F.col("heading").rlike("(?i)" + heading) | F.col("body").rlike("(?i)" + marker)
    text = F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.when(chosen, F.struct("pos", "heading", "body")))), lambda x: F.concat_ws("\n", x["heading"], x["body"])))
    return sections.groupBy("id").agg(text.alias("t")).select("id", F.when(F.char_length("t") >= least, F.col("t")).alias("text"))


def validated(findings: DataFrame, vocabularies: dict[str, tuple]) -> DataFrame:
    """(id, ok, bad) per listing: one value outside its vocabulary rejects the listing's whole record; null is allowed."""
    good = reduce(and_, [F.col(c).isNull() | F.col(c).isin(*v) for c, v in vocabularies.items()])
    return findings.groupBy("id").agg(F.bool_and(good).alias("ok"), F.count_if(~good).alias("bad"))


def choose_geocode(candidates: DataFrame) -> DataFrame:
    """(id, candidate, pass) of the first acceptable candidate: strict, then relaxed, then fallback, by rank.

    Foreign ones are out. Strict: the wanted postcode, if one is wanted. Relaxed:
    street level, the same two-digit region, and precise unless the postcode is the wanted one.
    """
    same = F.col("postcode") == F.col("wanted")
    strict = F.col("wanted").isNull() | F.coalesce(same, F.lit(False))
    relaxed = F.col("street_level") & (F.substring("postcode", 1, 2) == F.substring("wanted", 1, 2)) & (F.col("precise") | F.coalesce(same, F.lit(False)))
    passed = F.when(F.col("search") == "fallback", F.when(strict | F.coalesce(relaxed, F.lit(False)), 3)).when(strict, 1).when(F.coalesce(relaxed, F.lit(False)), 2)
    rows = candidates.filter("country = 'NO'").withColumn("pass", passed).filter("pass is not null")
    return J.first_per_key(rows, ["id"], "pass", "rank").select("id", "candidate", "pass")


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, heading, language, links and numbers of a landed page; each null where the page has none."""
    def found(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("html", pattern, 1)), F.lit(""))

    return pages.select(
        "page_id", found(r"(?is)<title>(.*?)</title>").alias("title"), found(r"(?is)<h1[^>]*>(.*?)</h1>").alias("heading"), found(r'(?is)<html[^>]*\blang="([^"]*)"').alias("lang"),
        F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("n_links"), S.last_digits("url").alias("uid"), F.sha2(F.col("html").cast("binary"), 256).alias("sha"),
    )
