"""Gates, caches, overrides, corrections and texts around the nightly job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S

MOST_FAILURES = 0.2


def ingest_gate(crawls: DataFrame, by: str) -> DataFrame:
    """(by, crawled, failed, verdict): a crawl without pages, or with too many failures, must not switch off what it did not see. ``crawls``: by, ok."""
    counts = crawls.groupBy(by).agg(F.count("ok").alias("crawled"), F.count_if(~F.col("ok")).alias("failed"))
    rate = F.col("failed") / F.when(F.col("crawled") > 0, F.col("crawled"))
    return counts.withColumn("verdict", F.when(F.col("crawled") == 0, "no pages").when(rate > MOST_FAILURES, "too many failures").otherwise("ok"))


def import_cache(cache: DataFrame, incoming: DataFrame, key: str = "sha", defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(cache after the import, one row imported, replaced). Optional columns get defaults; a row without its key stops the import before anything is written. Of rows that repeat a key the one with the largest values stays."""
    full = incoming
    for name, value in (defaults or {}).items():
        full = full.withColumn(name, F.lit(value)) if name not in full.columns else full
    bad = full.filter(F.col(key).isNull()).count()
    if bad:
        raise ValueError(f"{bad} rows without {key}")
    others = [c for c in full.columns if c != key]
    full = full.groupBy(key).agg(F.max(F.struct(*others)).alias("row_")).select(key, *[F.col("row_")[c].alias(c) for c in others]) if others else full.distinct()
    old = cache.select(key).distinct()
    counts = full.join(old.withColumn("old_", F.lit(True)), key, "left").agg(F.count_if(F.col("old_").isNull()).alias("imported"), F.count("old_").alias("replaced"))
    return cache.join(full.select(key), key, "left_anti").unionByName(full.select(*cache.columns)), counts


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual corrections by id: a price if there is one, texts only if they are not empty."""
    o = overrides.select("id", F.col("pris").alias("o_pris"), *[F.nullif(F.col(c), F.lit("")).alias(f"o_{c}") for c in ("adresse", "postnummer")])
    joined = rows.join(o, "id", "left")
    return joined.select(*[F.coalesce(f"o_{c}", c).alias(c) if c in ("pris", "adresse", "postnummer") else F.col(c) for c in rows.columns])


def apply_geocodes(geo: DataFrame, found: DataFrame) -> DataFrame:
    """Places set where the found ones are plausible (swapped ones turned), which clears the failure mark; other attempts set the mark."""
    fresh = found.select("id", S.normal_coordinates("lat", "lng").alias("c")).select("id", F.col("c.lat").alias("new_lat"), F.col("c.lng").alias("new_lng"), F.lit(True).alias("tried"))
    joined = geo.join(fresh, "id", "full")
    good = F.col("new_lat").isNotNull()
    mark = F.when(good, 0).when(F.col("tried"), 1).otherwise(F.col("geocode_failed"))
    return joined.select("id", F.when(good, F.col("new_lat")).otherwise(F.col("lat")).alias("lat"), F.when(good, F.col("new_lng")).otherwise(F.col("lng")).alias("lng"), mark.cast("int").alias("geocode_failed"))


def refresh_derived(rows: DataFrame, derived: DataFrame, columns: list[str]) -> DataFrame:
    """Only the ids whose derived values differ from those held, null apart from any value, with the new values."""
    held = rows.select("id", *[F.col(c).alias(f"held_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"held_{c}"))
    return derived.join(held, "id").filter(differs).select("id", *columns)


def prune_selection(selected: DataFrame, vocabulary: DataFrame, complete: bool) -> DataFrame:
    """Selected (field, value) rows that the vocabulary has; all of them where it may be incomplete."""
    return selected.join(vocabulary.select("field", "value"), ["field", "value"], "left_semi") if complete else selected


def line_id(x: Column) -> Column:
    """A line's id in upper case; blank and null are UNASSIGNED."""
    return F.coalesce(F.nullif(F.upper(F.trim(x)), F.lit("")), F.lit("UNASSIGNED"))


def timestamp_utc(x: Column) -> Column:
    """ISO or 'YYYY-MM-DD HH:MM:SS' text as an instant, UTC where no zone is given; null for other text. The session's zone must be UTC."""
    t = F.trim(x)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(t))


def plain_id(x: Column) -> Column:
    """The id if it is made of ASCII letters, digits, dash, colon and underscore, else null."""
    return F.when(x.rlike(r"^[A-Za-z0-9_:-]+$"), x)


def daily_message(added: Column, sold: Column, delisted: Column, active: Column) -> Column:
    return F.format_string("\U0001F3E0 Today: +%d added, -%d removed (%d sold, %d delisted). Active: %d.", added, sold + delisted, sold, delisted, active)


def weekly_message(added: Column, sold: Column) -> Column:
    return F.format_string("\U0001F4C5 This week: +%d added, %d sold.", added, sold)


def percent(share: Column, digits: int = 0) -> Column:
    """A share as a percentage, half up."""
    scale = 10**digits
    return F.format_string(f"%.{digits}f%%", F.floor(share * 100 * scale + 0.5) / scale)


def progress_message(suspended: Column, new: Column, priced: Column, total: Column) -> Column:
    """How far the prices of sold listings are known; "" while there is nothing to say."""
    share = F.coalesce(priced / F.nullif(total, F.lit(0)), F.lit(0.0))
    lead = F.when(suspended, "SUSPENDED (throttled) — ").otherwise(F.format_string("+%d today, ", new))
    text = F.concat(F.lit("\U0001F4B0 Sold prices: "), lead, priced.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), percent(share), F.lit(") covered."))
    return F.when(~suspended & (new == 0) & (total == 0), "").otherwise(text)


def drift_messages(findings: DataFrame, *by: str) -> DataFrame:
    """(by, message): a line for each field that drifted, by name, under their number. ``findings``: as ``drift_findings`` gives them; fields are few."""
    line = F.concat(F.col("column"), F.lit("  "), percent(F.col("base_rate"), 1), F.lit(" -> "), percent(F.col("rate"), 1), F.lit("  (n="), F.col("n").cast("string"), F.lit(")"))
    lines = F.array_sort(F.collect_list(line))
    head = F.format_string("Parser drift: %d field(s)", F.count("*"))
    return findings.groupBy(*by).agg(F.array_join(F.concat(F.array(head), lines), "\n").alias("message"))


def repair_rows(table: DataFrame, wanted: DataFrame, seed: DataFrame, wrong: DataFrame, key: str) -> DataFrame:
    """The seed rows added where their key is missing, but only if any of ``wanted`` is in the table; rows of ``wrong`` keys taken out."""
    # One row if any of ``wanted`` is there, none otherwise; the plan stays lazy.
    there = table.join(wanted, key, "left_semi").limit(1).select(F.lit(True).alias("there_"))
    kept = table.join(wrong, key, "left_anti")
    missing = seed.join(kept.select(key), key, "left_anti")
    return kept.unionByName(missing.join(F.broadcast(there), F.lit(True), "left_semi"))
