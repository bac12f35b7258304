"""Visibility and selection filters. Each says what null does, since the buckets differ in that."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listaro.config import CONFIG, Config
from listaro.functions import scalars as S


def drop_excluded(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Without ads of the excluded path classes."""
    return df.filter(~is_excluded(cfg))


def is_excluded(cfg: Config = CONFIG) -> Column:
    return F.coalesce(F.lower(F.trim("url")).rlike("/(" + "|".join(cfg.excluded_paths) + ")/"), F.lit(False))


def visible_active(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Active, not closed, within price and area; an unknown price or area is out."""
    return df.filter(is_visible_active(cfg))


def is_visible_active(cfg: Config = CONFIG) -> Column:
    return F.col("active") & ~S.status_key("status").isin(*cfg.closed) & (F.col("pris") <= cfg.max_price) & (F.col("bra_i") >= cfg.min_area)


def visible_closed(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Inactive with a closed status; an unknown price counts as 0."""
    return df.filter(is_visible_closed(cfg))


def is_visible_closed(cfg: Config = CONFIG) -> Column:
    return ~F.col("active") & S.status_key("status").isin(*cfg.closed) & price_eligible(cfg.max_price) & (F.col("bra_i") >= cfg.min_area)


def visible_source_b(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Rows of the second source that point at no listing of the first; an unknown price counts as 0."""
    return df.filter(F.col("active") & price_eligible(cfg.max_price) & (F.coalesce(F.trim("duplicate_of"), F.lit("")) == ""))


def price_eligible(cap: int | None) -> Column:
    return F.lit(True) if cap is None else F.coalesce("pris", F.lit(0)) <= cap


def tracked_ids(df: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    return df.filter(F.col("active") & (F.col("pris") <= cfg.max_price) & (F.col("bra_i") >= cfg.min_area)).select("id")


def refresh_candidates(df: DataFrame, mode: str, cfg: Config = CONFIG) -> DataFrame:
    """all: every listing; inactive: inactive within the caps; open: those of them that are not closed yet."""
    if mode == "all":
        return df
    capped = df.filter(~F.col("active") & price_eligible(cfg.max_price) & (F.col("bra_i") >= cfg.min_area))
    return capped if mode == "inactive" else capped.filter(~S.status_key("status").isin(*cfg.closed))


def missing_coordinates(listings: DataFrame, geo: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Listings without coordinates whose geocoding has not failed before."""
    rows = listings if include_inactive else listings.filter("active")
    return rows.join(geo.select("id", "lat", "lng", "geocode_failed"), "id", "left").filter((F.col("lat").isNull() | F.col("lng").isNull()) & (F.coalesce("geocode_failed", F.lit(0)) == 0))


def in_polygon(lng: Column, lat: Column, polygon=CONFIG.polygon) -> Column:
    """Even-odd ray cast as one expression over the polygon's edges; null coordinates are null."""
    edges = list(zip(polygon, [polygon[-1], *polygon[:-1]]))
    crossed = [((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lng < (x2 - x1) * (lat - y1) / ((y2 - y1) or 1e-12) + x1) for (x1, y1), (x2, y2) in edges]
    return reduce(lambda a, b: a.cast("int").bitwiseXOR(b.cast("int")).cast("boolean"), crossed)


def in_bbox(lng: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lng.between(west, east) & lat.between(south, north)


def matches_text(needle: str, *columns: str) -> Column:
    """Any column contains the needle, whatever its case; an empty needle matches all."""
    return reduce(or_, [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.strip().lower()), F.lit(False)) for c in columns])


def fresh(since: str, as_of: Column, days: int = 3) -> Column:
    return F.coalesce(S.age_days(since, as_of).between(0, days), F.lit(False))


def bucket_of() -> Column:
    """sold, inactive or active, by status and activity."""
    s = S.status_key("status")
    return F.when(F.col("active"), "active").when(s == "solgt", "sold").when(s == "inaktiv", "inactive").otherwise("active")


@dataclass(frozen=True)
class Filters:
    """A listing selection. A bound of None is off; an empty selection is off."""

    at_most: dict[str, float]
    at_least: dict[str, float]
    travel_max: dict[str, int]
    selected: dict[str, tuple[str, ...]]
    selected_sets: dict[str, tuple[str, ...]]
    facilities: tuple[str, ...] = ()
    include_unknown: bool = True
    sold_at_most: dict[str, float] | None = None


def listing_excluded(f: Filters) -> Column:
    """True where a listing fails the selection, by three policies on what is unknown.

    Sliders and selected sets: unknown fails only if include_unknown is off.
    Travel: missing never fails, a failure code counts as 999 minutes.
    Selections: unknown is the value "", which can be chosen like any other.
    Sale bounds hold for sold rows only; facilities must all be there, and an empty list is unknown.
    """
    unknown = F.lit(not f.include_unknown)
    tests = [F.when(F.col(c).isNull(), unknown).otherwise(F.col(c) > v) for c, v in f.at_most.items()]
    tests += [F.when(F.col(c).isNull(), unknown).otherwise(F.col(c) < v) for c, v in f.at_least.items()]
    tests += [F.coalesce(F.when(F.col(c) < 0, 999).otherwise(F.col(c)) > v, F.lit(False)) for c, v in f.travel_max.items()]
    tests += [~F.coalesce(F.col(c), F.lit("")).isin(*v) for c, v in f.selected.items() if v]
    tests += [F.when(F.coalesce(F.col(c), F.lit("")) == "", unknown).otherwise(~F.col(c).isin(*v)) for c, v in f.selected_sets.items() if v]
    tests += [F.col("sold") & F.when(F.col(c).isNull(), unknown).otherwise(F.col(c) > v) for c, v in (f.sold_at_most or {}).items()]
    if f.facilities:
        required = F.array(*[F.lit(x) for x in f.facilities])
        tests.append(F.when(F.coalesce(F.size("facilities"), F.lit(0)) <= 0, unknown).otherwise(F.size(F.array_except(required, "facilities")) > 0))
    return reduce(or_, tests) if tests else F.lit(False)


def partition_rows(df: DataFrame, universe: Column, excluded: Column, text: Column, focus: str | None = None) -> DataFrame:
    """Flags in_universe and shown; a focused id is always shown."""
    shown = universe & ~excluded & text
    return df.withColumn("in_universe", universe).withColumn("shown", shown | (F.col("id") == focus) if focus else shown)


def asset_candidates(listings: DataFrame, existing: DataFrame) -> DataFrame:
    """Active listings with an image address whose image is not there yet."""
    return listings.filter(F.col("active") & (F.coalesce(F.trim("image_url"), F.lit("")) != "")).join(existing, "id", "left_anti")
