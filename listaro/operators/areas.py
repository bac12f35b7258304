"""Points in polygons, many of both: polygons are covered with grid cells, points meet them by cell.

A cell that no edge comes near lies inside or outside as a whole; only points of
the other cells are cast a ray for. The cell's size follows the polygon's, so a
polygon has no more than a fixed number of cells; sizes are powers of two, and a
point is keyed once for each size in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a polygon's longer side, about.
CELLS = 24
_TINY = 1e-12


def holds(corners: Column, lng: Column, lat: Column) -> Column:
    """Even-odd ray cast over an array of struct(lng, lat); corners must be finite."""
    before = F.concat(F.slice(corners, F.size(corners), 1), F.slice(corners, 1, F.greatest(F.size(corners) - 1, F.lit(0))))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        rise = F.when(b["lat"] - a["lat"] == 0, _TINY).otherwise(b["lat"] - a["lat"])
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lng < (b["lng"] - a["lng"]) * (lat - a["lat"]) / rise + a["lng"])

    edges = F.zip_with(corners, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crossed(e))


def finite_corners(corners: Column) -> Column:
    """The corners whose coordinates are both finite numbers; the others are skipped."""
    good = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    return F.filter(corners, lambda p: good(p["lng"]) & good(p["lat"]))


def cover(areas: DataFrame) -> DataFrame:
    """(area, level, x, y, corners): the cells of side 2^level degrees that a polygon touches; corners only where a point of the cell need not be inside.

    ``areas``: area, corners array<struct<lng, lat>>. Polygons with fewer than three finite corners hold nothing.
    """
    rows = areas.select("area", finite_corners(F.col("corners")).alias("corners")).filter(F.size("corners") >= 3)
    side = lambda c: (F.array_min(F.transform("corners", lambda p: p[c])), F.array_max(F.transform("corners", lambda p: p[c])))
    (west, east), (south, north) = side("lng"), side("lat")
    rows = rows.withColumns({"west": west, "east": east, "south": south, "north": north})
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-9))
    rows = rows.withColumn("level", F.ceil(F.log2(span / CELLS)).cast("int")).withColumn("size", F.pow(F.lit(2.0), F.col("level")))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("size")), F.floor(F.col(b) / F.col("size"))))
    rows = rows.withColumn("x", cells("west", "east")).withColumn("y", cells("south", "north"))
    left, low = F.col("x") * F.col("size"), F.col("y") * F.col("size")
    before = F.concat(F.slice("corners", F.size("corners"), 1), F.slice("corners", 1, F.size("corners") - 1))

    def beside(a: Column, b: Column) -> Column:
        """The edge's box and the cell have a point in common."""
        return (F.greatest(a["lng"], b["lng"]) >= left) & (F.least(a["lng"], b["lng"]) <= left + F.col("size")) & (F.greatest(a["lat"], b["lat"]) >= low) & (F.least(a["lat"], b["lat"]) <= low + F.col("size"))

    border = F.exists(F.zip_with("corners", before, beside), lambda x: x)
    inside = holds(F.col("corners"), left + F.col("size") / 2, low + F.col("size") / 2)
    return rows.withColumn("border", border).filter(F.col("border") | inside).select("area", "level", "x", "y", F.when(F.col("border"), F.col("corners")).alias("corners"))


def in_areas(rows: DataFrame, areas: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, area) for each polygon that holds a row's place; rows without two finite coordinates are in none. ``rows``: id, lng, lat."""
    cells = cover(areas)
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # few: one for each doubling of size
    good = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    points = rows.filter(good("lng") & good("lat")).select(id_col, "lng", "lat", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
    size = F.pow(F.lit(2.0), F.col("level"))
    points = points.withColumns({"x": F.floor(F.col("lng") / size), "y": F.floor(F.col("lat") / size)})
    met = points.join(cells, ["level", "x", "y"])
    return met.filter(F.col("corners").isNull() | holds(F.col("corners"), F.col("lng"), F.col("lat"))).select(id_col, "area")


def outside(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows with known places that no polygon holds. ``rows``: source, id, lng, lat; ids are unique within a source."""
    known = rows.filter(F.coalesce(F.abs("lng") < float("inf"), F.lit(False)) & F.coalesce(F.abs("lat") < float("inf"), F.lit(False)))
    keyed = known.withColumn("key", F.struct("source", "id"))
    return keyed.join(in_areas(keyed, areas, "key").select("key").distinct(), "key", "left_anti").drop("key")
