"""The nested listing payload of three buckets, and the look-up of single listings in it.

One star join by id feeds it: listings with their places, details, prose facts
and roll-up, each of at most one row per id, so all five are dealt once by the
same key. Children join as lists. The written payload is divided by a checksum of
the id, so a look-up reads the few parts that its ids lie in.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listaro.config import CONFIG, Config
from listaro.functions import scalars as S
from listaro.operators import filters as O
from listaro.operators import joins as J
from listaro.operators import publish as B

#: The payload's keys that come from the page's details, from prose, and from the findings' roll-up.
DETAILS = ("soverom", "rom", "etasje", "eieform", "nabolag", "energimerke", "energifarge", "totalpris", "omkostninger", "fellesgjeld", "felleskost_mnd", "fellesformue", "formuesverdi", "kommunale_avg_aar", "verditakst")
PROSE = ("boligselgerforsikring", "ferdigattest", "radon_omtalt", "utleie", "husdyr", "heftelser")
ROLLUP = {"reparasjon_lav": "lav", "reparasjon_hoy": "hoy", "reparasjon_est": "est", "alvorlighet": "alvorlighet", "verste_bygningsdel": "verste", "reparasjon_kilde": "kilde"}
PARTS = 64


def listing_base(listings: DataFrame, geo: DataFrame, details: DataFrame, prose: DataFrame, rollup: DataFrame) -> DataFrame:
    """Every listing with its sides, null where a side has no row. The tax comes from the details first, then from prose."""
    base = J.listing_base(listings, geo, details.withColumnRenamed("eiendomsskatt_kr", "tax_d"), prose.withColumnRenamed("eiendomsskatt_kr", "tax_p"), rollup)
    return base.withColumn("eiendomsskatt_kr", F.coalesce("tax_d", "tax_p"))


def items(base: DataFrame, status: Column, closed: Column) -> DataFrame:
    """One nested row per listing of the first source, with its ``bucket``."""
    image = F.coalesce(F.trim("image_url"), F.lit("")) != ""
    rows = base.select(
        "id", "adresse", "postnummer", "pris", S.price_per_m2("pris", "bra_primary", "bra_i", "bra_total").alias("pris_kvm"), "boligtype", status.alias("tilgjengelighet"), "lat", "lng", "brj", "mvv", "bra_i", "byggeaar",
        "url", image.alias("image"), "scraped_at", F.lit("a").alias("source"), (closed & F.coalesce(status == "Solgt", F.lit(False))).alias("sold"), (closed & status.isNotNull()).alias("closed"),
        *DETAILS, S.total_per_m2("totalpris", "bra_i").alias("pris_kvm_totalpris"), S.monthly_cost("felleskost_mnd", "kommunale_avg_aar").alias("maanedskost"), "eiendomsskatt_kr", *PROSE,
        *[F.col(c).alias(k) for k, c in ROLLUP.items()], F.coalesce("facilities", F.array().cast("array<string>")).alias("facilities"), "findings", "bucket",
    )
    return B.payload(rows)


def second_items(rows: DataFrame) -> DataFrame:
    """One row per listing of the second source, by a hash of its URL; it has fewer keys."""
    return rows.select(S.hash_id("url").alias("id"), "adresse", S.padded_postcode("postnummer").alias("postnummer"), "pris", "boligtype", "lat", "lng", "url", F.lit(False).alias("image"), F.lit("b").alias("source"), F.lit(False).alias("sold"), F.lit(False).alias("closed"), F.array().cast("array<string>").alias("facilities"))


def full_payload(base: DataFrame, facilities: DataFrame, findings: DataFrame, sold: DataFrame, second: DataFrame, as_of: Column, cfg: Config = CONFIG) -> DataFrame:
    """Active, closed and second-source listings in one table, with ``bucket``; keys that a bucket lacks are null. ``sold``: id, sold_price."""
    # Active and closed exclude each other, so a listing meets its sides, its children and its sale once, for whichever shows it.
    bucket = F.when(O.is_visible_active(cfg), "active").when(O.is_visible_closed(cfg), "closed")
    shown = J.with_children(base.withColumn("bucket", bucket).filter("bucket is not null"), facilities, findings).join(sold.select("id", "sold_price"), "id", "left")
    closed = F.col("bucket") == "closed"
    status = F.when(closed, S.closed_status("active", "status", "sold_price", "updated_at", as_of, cfg.grace_days)).otherwise(F.col("status"))
    return items(shown, status, closed).unionByName(second_items(O.visible_source_b(second, cfg)).withColumn("bucket", F.lit("b")), allowMissingColumns=True)


def write_payload(payload: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write the payload divided by the checksum of the id."""
    rows = payload.withColumn("part", (F.crc32(F.col("id").cast("binary")) % parts).cast("int"))
    rows.repartition("part").write.partitionBy("part").mode("overwrite").parquet(path)


def detail(spark: SparkSession, path: str, ids: list[str], parts: int = PARTS) -> DataFrame:
    """The payload's rows of these ids, of either source; only the parts that they lie in are read."""
    there = sorted({zlib.crc32(i.encode()) % parts for i in ids})
    return spark.read.parquet(path).filter(F.col("part").isin(there) & F.col("id").isin(list(ids))).drop("part")
