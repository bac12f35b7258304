"""Cost bands that a report's prose states: found with their places, snapped outward to the grid, and cut from the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grid of cost bounds.
GRID = (0, 10_000, 20_000, 50_000, 100_000, 200_000, 300_000, 500_000, 1_000_000)
#: Words that announce a stated cost.
LABELS = ("kostnadsestimat", "kostnadsoverslag", r"utbedringskostnad\w*", r"oppgraderingskostnad\w*", r"estimert\w* kostnad\w*", r"(?:sjablongmessig\w* |estimert\w* )?prisanslag")
_NUMBER = r"(?:\d{1,3}(?:[ .\xA0]\d{3})+|\d{4,})"
_AMOUNT = rf"(?:kr\.?\s*)?{_NUMBER}"
#: A label, and a bound that is open on one side, or two bounds.
STATED = rf"(?i)\b(?:{'|'.join(LABELS)})(?:\s+gjelder(?:\s+er)?)?\s*:?\s*(?:(?:under|over)\s+{_AMOUNT}|{_AMOUNT}\s*(?:-|–|til)\s*{_AMOUNT})"
_BEGIN, _END = "\x01", "\x02"


def snapped(low: Column, high: Column, grid: tuple[int, ...] = GRID) -> Column:
    """struct(low, high): the grid's bounds around a band, never narrower than it is but at the grid's ends."""
    steps = F.array(*[F.lit(g).cast("long") for g in grid])
    below, above = F.array_max(F.filter(steps, lambda g: g <= low)), F.array_min(F.filter(steps, lambda g: g >= high))
    return F.struct(F.coalesce(below, F.lit(0).cast("long")).alias("low"), F.coalesce(above, F.lit(grid[-1]).cast("long")).alias("high"))


def _pieces(text: Column) -> Column:
    """The text in pieces: every second one, from the second on, states a cost."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_BEGIN}{_END}]", " ")
    return F.split(F.regexp_replace(plain, STATED, f"{_BEGIN}$0{_END}"), f"[{_BEGIN}{_END}]")


def _with(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _band(raw: Column, grid: tuple[int, ...]) -> Column:
    def made(amounts: Column) -> Column:
        first, second = F.get(amounts, F.lit(0)), F.get(amounts, F.lit(1))
        below = F.lower(raw).rlike(r"\bunder\b")
        bounds = F.when(second.isNotNull(), F.struct(first.alias("low"), second.alias("high"))).when(below, F.struct(F.lit(0).cast("long").alias("low"), first.alias("high"))).otherwise(F.struct(first.alias("low"), F.lit(grid[-1]).cast("long").alias("high")))
        return _with(bounds, lambda b: F.when((first >= 1000) & (b["low"] <= b["high"]), snapped(b["low"], b["high"], grid)))

    return _with(F.transform(F.regexp_extract_all(raw, F.lit(_NUMBER), 0), lambda x: F.regexp_replace(x, r"\D", "").try_cast("long")), made)


def stated_bands(text: Column, grid: tuple[int, ...] = GRID) -> Column:
    """array of struct(begin, end, low, high): each stated band, where it stands in the text (from 0, the end not included), and its bounds on the grid.

    A range whose first bound is above its second is not taken. Null and empty texts state none.
    """
    def found(parts: Column) -> Column:
        stated = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["i"] % 2 == 1)
        begin = lambda p: F.aggregate(F.slice(parts, 1, p["i"]), F.lit(0), lambda n, x: n + F.length(x))
        return F.transform(stated, lambda p: F.struct(begin(p).alias("begin"), F.length(p["x"]).alias("size"), _band(p["x"], grid).alias("b")))

    kept = F.filter(_with(_pieces(text), found), lambda b: b["b"].isNotNull())
    return F.transform(kept, lambda b: F.struct(b["begin"], (b["begin"] + b["size"]).alias("end"), b["b"]["low"].alias("low"), b["b"]["high"].alias("high")))


def without_stated(text: Column) -> Column:
    """The text without its stated costs, labels and all; null stays null."""
    return F.when(text.isNotNull(), F.array_join(F.filter(_pieces(text), lambda x, i: i % 2 == 0), ""))


def band_report(stated: DataFrame, estimated: DataFrame, by: str, grid: tuple[int, ...] = GRID) -> DataFrame:
    """Stated and estimated bands (by, low, high) of each key, paired in the order of their middles: one row of counts.

    within_one: both bounds are at most one step of the grid apart; higher and
    lower compare the middles; the unmatched are what one side has more of.
    """
    def ranked(df: DataFrame, name: str) -> DataFrame:
        # A key is one report, so its bands are few.
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("low") + F.col("high"), "low"))
        return df.select(by, place.alias("place"), F.struct("low", "high").alias(name))

    step = lambda x: F.array_position(F.array(*[F.lit(g).cast("long") for g in grid]), x)
    s, e = F.col("s"), F.col("e")
    near = (F.abs(step(s["low"]) - step(e["low"])) <= 1) & (F.abs(step(s["high"]) - step(e["high"])) <= 1)
    middle = lambda x: x["low"] + x["high"]
    both = ranked(stated, "s").join(ranked(estimated, "e"), [by, "place"], "full")
    return both.agg(
        F.count_if(s.isNotNull() & e.isNotNull()).alias("pairs"), F.count_if(s == e).alias("exact"), F.count_if(near).alias("within_one"), F.count_if(middle(e) > middle(s)).alias("higher"),
        F.count_if(middle(e) < middle(s)).alias("lower"), F.count_if(e.isNull()).alias("stated_unmatched"), F.count_if(s.isNull()).alias("estimated_unmatched"),
    )
