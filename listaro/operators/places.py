"""Places of rows in an order, without one task per group: rows are dealt by ranges, counted, and placed by what stands before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listaro.staging import shuffle_width, stage


def placed(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with each row's place (long, from 1) within its keys, in the given order; all of a group's rows in many tasks.

    Rows are dealt to ranges of (keys, order) and sorted there, so a group lies
    in neighbouring ranges. One row per range and group is counted, and a row's
    place is its place in the range plus the group's rows in the ranges before.
    Rows that the order does not tell apart have some order among them.
    """
    spark, columns = rows.sparkSession, rows.columns
    by = [*keys, *order]
    sorted_rows = rows.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by).withColumn("no_", F.monotonically_increasing_id())
    # The numbers are written with the rows: another run may deal them otherwise.
    held = stage(sorted_rows, "placed", rebalance=False).withColumn("range_", F.shiftright("no_", 33))
    counts = held.groupBy("range_", *keys).agg(F.min("no_").alias("first_"), F.count("*").alias("n_"))
    # Per group as many rows as it has ranges.
    before = F.sum("n_").over(Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    counts = stage(counts.withColumn("before_", F.coalesce(before, F.lit(0))).drop("n_"), "placed-counts")
    same = [held["range_"] == counts["range_"], *[held[k].eqNullSafe(counts[k]) for k in keys]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    place = counts["before_"] + held["no_"] - counts["first_"] + 1
    return held.join(counts, on).select(*[held[c] for c in columns], place.alias(name))


#: National letters behind z, in their order, as signs that sort there; marked ones beside their plain letter.
_LETTERS, _SIGNS = "æäøöåéèêüáàóò", "{{||}eeeuaaoo"


def text_key(x: Column) -> Column:
    """Sorts text whatever its case, with the national letters behind z; blank is null."""
    return F.nullif(F.translate(F.lower(F.trim(x)), _LETTERS, _SIGNS), F.lit(""))


def rank_key(x: Column, ranks: tuple[str, ...]) -> Column:
    """Sorts values by their place in ``ranks``; others are null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, ranks)), F.lower(F.trim(x))), F.lit(0))


def sort_table(rows: DataFrame, key: Column, descending: bool, tie: str = "id") -> DataFrame:
    """``rows`` with ``place`` in the order of a key, up or down; null keys are last either way, equal ones in the order of ``tie``."""
    keyed = rows.withColumn("key_", key).withColumn("blank_", F.col("key_").isNull())
    return placed(keyed, [], ["blank_", F.col("key_").desc() if descending else F.col("key_").asc(), tie]).drop("key_", "blank_")
