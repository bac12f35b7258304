"""All queries of the listing engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listaro.plans import documents, extra, more, nightly, pages, payloads, reading, rest, streams, tables

PLANS = (reading, nightly, documents, more, rest, pages, tables, payloads, extra, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.visible_active(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
