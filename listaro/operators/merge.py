"""Merge policies: what wins when a row comes again. Each is a join and a projection over immutable tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_listings(base: DataFrame, incoming: DataFrame, columns: list[str], as_of: Column, marks: bool = False) -> DataFrame:
    """Change-detecting upsert with ``outcome``: inserted rows are active; known ones come back to life; updated_at moves only on a change.

    With ``marks`` also ``came`` (was it among the incoming?) and ``was_active``, so that nothing has to meet them again.
    """
    new = incoming.select("id", *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("came"))
    old = base.select("id", "active", "updated_at", *columns, F.lit(True).alias("was"))
    both = old.join(new, "id", "full")
    differs = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in columns]) | ~F.coalesce("active", F.lit(False))
    came, was = F.col("came").isNotNull(), F.col("was").isNotNull()
    changed = came & (~was | differs)
    return both.select(
        "id", *[F.when(came, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.when(came, True).otherwise(F.col("active")).alias("active"),
        F.when(changed, as_of).otherwise(F.col("updated_at").cast("timestamp")).alias("updated_at"),
        F.when(~was, "inserted").when(changed, "updated").otherwise("same").alias("outcome"),
        *([came.alias("came"), F.coalesce("active", F.lit(False)).alias("was_active")] if marks else []),
    )


def merge_by_rules(base: DataFrame, incoming: DataFrame, rules: dict[str, str], key: str = "id") -> DataFrame:
    """Upsert by a rule per column: fill (a new value if there is one), first (the old one if there is one), set (the new one, null too)."""
    new = incoming.select(key, *[F.col(c).alias(f"n_{c}") for c in rules], F.lit(True).alias("came"))
    both = base.select(key, *rules).join(new, key, "full")
    made = {"fill": lambda c: F.coalesce(f"n_{c}", c), "first": lambda c: F.coalesce(c, f"n_{c}"), "set": lambda c: F.when(F.col("came"), F.col(f"n_{c}")).otherwise(F.col(c))}
    return both.select(key, *[made[rule](c).alias(c) for c, rule in rules.items()])


def replace_children(base: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """All children of a key that came again are replaced, without repeats; others stay."""
    return base.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.dropDuplicates())


def import_protected(stored: DataFrame, imported: DataFrame, as_of: Column) -> DataFrame:
    """Notes from a sheet: written only where they differ and nobody edited the row since its last import."""
    new = imported.select("id", F.col("note").alias("n_note"), F.lit(True).alias("came"))
    both = stored.select("id", "note", "imported_at", "updated_at", F.lit(True).alias("was")).join(new, "id", "full")
    take = F.col("came").isNotNull() & (F.col("was").isNull() | (~F.col("note").eqNullSafe(F.col("n_note")) & F.col("updated_at").eqNullSafe(F.col("imported_at"))))
    return both.select("id", F.when(take, F.col("n_note")).otherwise(F.col("note")).alias("note"), F.when(take, as_of).otherwise(F.col("imported_at")).alias("imported_at"), F.when(take, as_of).otherwise(F.col("updated_at")).alias("updated_at"), take.alias("written"))


def apply_edits(stored: DataFrame, edits: DataFrame, as_of: Column) -> DataFrame:
    """Edits of notes: a blank one leaves an empty row if the note was imported, and deletes it otherwise."""
    both = stored.join(edits.select("id", F.trim("note").alias("e_note"), F.lit(True).alias("edited")), "id", "full")
    blank = F.col("edited").isNotNull() & (F.coalesce("e_note", F.lit("")) == "")
    kept = both.filter(~(blank & F.col("imported_at").isNull()))
    return kept.select("id", F.when(blank, None).when(F.col("edited"), F.col("e_note")).otherwise(F.col("note")).alias("note"), "imported_at", F.when(F.col("edited"), as_of).otherwise(F.col("updated_at")).alias("updated_at"))


def apply_status(base: DataFrame, news: DataFrame, as_of: Column) -> DataFrame:
    """New statuses; updated_at moves only where the status differs, null and empty being the same."""
    both = base.join(news.select("id", F.col("status").alias("n_status"), F.lit(True).alias("came")), "id", "left")
    differs = F.col("came").isNotNull() & (F.coalesce("status", F.lit("")) != F.coalesce("n_status", F.lit("")))
    return both.select("id", F.when(differs, F.col("n_status")).otherwise(F.col("status")).alias("status"), F.when(differs, as_of).otherwise(F.col("updated_at").cast("timestamp")).alias("updated_at"), differs.alias("changed"))


def record_attempts(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Counters with one more for each id that was tried."""
    return stored.select("id", "attempts").unionByName(ids.select("id", F.lit(1).alias("attempts"))).groupBy("id").agg(F.sum("attempts").alias("attempts"))


def keyed_replace(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` in place of those with their key."""
    return base.join(incoming, key, "left_anti").unionByName(incoming)


def relabel(df: DataFrame, column: str, old: str, new: str, before: Column, stamp: str) -> DataFrame:
    return df.withColumn(column, F.when((F.col(column) == old) & (F.col(stamp) < before), new).otherwise(F.col(column)))
