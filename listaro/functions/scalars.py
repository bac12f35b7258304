"""Column functions of the listing domain; all run in the JVM and keep null apart from zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from listaro.config import CONFIG

EARTH_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x) -> Column:
    """A double, or null for what is not a number."""
    n = _c(x).try_cast("double")
    return F.when(~F.isnan(n), n)


def rounded(x) -> Column:
    """Half-even to a long; null for what is not a number."""
    return F.bround(number(x)).cast("long")


def int_or_zero(x) -> Column:
    return F.coalesce(number(x).cast("long"), F.lit(0).cast("long"))


def cell(x) -> Column:
    """Text for a sheet: null as empty, line breaks as spaces, trimmed."""
    return F.coalesce(F.trim(F.regexp_replace(_c(x).cast("string"), "[\n\r]", " ")), F.lit(""))


def padded_postcode(x) -> Column:
    """Numbers as four digits at least; other text trimmed; null and blank as empty."""
    s = F.trim(_c(x).cast("string"))
    n = number(s)
    return F.when(s.isNull() | (s == ""), "").when(n.isNull(), s).otherwise(F.when(n.cast("long") < 1000, F.lpad(n.cast("long").cast("string"), 4, "0")).otherwise(n.cast("long").cast("string")))


def postcode_key(x) -> Column:
    """Match key: a trailing .0 goes, short digits are padded; null as empty."""
    s = F.regexp_replace(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))), r"\.0$", "")
    return F.when(s.rlike(r"^\d{1,3}$"), F.lpad(s, 4, "0")).otherwise(s)


def postcode_digits(x) -> Column:
    """Digits only, padded to four; text without digits in lower case; null when blank."""
    s = F.trim(_c(x).cast("string"))
    digits = F.regexp_replace(s, r"\D", "")
    return F.when(F.coalesce(s, F.lit("")) == "", None).when(digits == "", F.lower(s)).when(F.length(digits) <= 4, F.lpad(digits, 4, "0")).otherwise(F.lower(s))


def address_key(x) -> Column:
    s = F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(s, r"""[.,©()"'\\/]+""", ""), r"\s+", " ")


def clean_address(x) -> Column:
    """Cut at each delimiter in turn, trimming each time; blank and null stay as they are."""
    cut = reduce(lambda c, d: F.when(c.contains(d), F.trim(F.substring_index(c, d, 1))).otherwise(c), (" - ", " (", " [", " /"), F.trim(_c(x)))
    return F.when(_c(x) == "", _c(x)).otherwise(cut)


def title_case(x) -> Column:
    """Upper case after any non-letter, lower case elsewhere."""
    s = _c(x)
    chars = F.split(s, "")
    at = F.transform(chars, lambda ch, i: F.when((i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(ch)).otherwise(F.lower(ch)))
    return F.when(s == "", s).otherwise(F.array_join(at, ""))


def map_url(adresse, postnummer) -> Column:
    url = F.concat(F.lit("https://www.google.com/maps/place/"), F.replace(F.concat(F.trim(_c(adresse)), F.lit("+"), F.trim(_c(postnummer))), F.lit(" "), F.lit("+")))
    return F.coalesce(url, F.lit(""))


def price_per_m2(pris, *areas) -> Column:
    """Half-even, by the first known area, which must be positive."""
    area = F.coalesce(*[number(a) for a in areas])
    return F.when(area > 0, F.bround(number(pris) / area).cast("long"))


def total_per_m2(total, area) -> Column:
    return F.when((_c(total) > 0) & (_c(area) > 0), F.bround(_c(total) / _c(area)).cast("long"))


def monthly_cost(shared, municipal_year) -> Column:
    """Unknown shared cost is unknown; unknown municipal fees count as 0."""
    return (_c(shared) + F.coalesce(F.bround(_c(municipal_year) / 12), F.lit(0))).cast("long")


def half_range(low, high) -> Column:
    return F.floor((_c(high) - _c(low)) / 2).cast("long")


def sold_total(price, debt) -> Column:
    return _c(price) + F.coalesce(_c(debt), F.lit(0))


def half_up(x) -> Column:
    """Half towards plus infinity."""
    return F.floor(_c(x) + 0.5)


def premium_pct(price, suggestion) -> Column:
    return F.when(_c(suggestion) > 0, (_c(price) - _c(suggestion)) / _c(suggestion) * 100.0)


def status_key(x) -> Column:
    return F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))


def age_days(since, as_of) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(_c(since).cast("timestamp"))) / 86_400_000_000.0


def closed_status(active, status, sold_price, updated_at, as_of, grace_days: int = CONFIG.grace_days) -> Column:
    """Solgt as it is, Inaktiv with a price promoted to Solgt, else Inaktiv while young (or of unknown age), then Trukket."""
    s, age = status_key(status), age_days(updated_at, as_of)
    return (
        F.when(_c(active), None)
        .when(s == "solgt", "Solgt")
        .when(s != "inaktiv", None)
        .when(_c(sold_price).isNotNull(), "Solgt")
        .when(age.isNull() | (age < grace_days), "Inaktiv")
        .otherwise("Trukket")
    )


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Metres on a sphere."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = F.radians(_c(lat2) - _c(lat1)), F.radians(_c(lng2) - _c(lng1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def normal_coordinates(lat, lng, bounds=CONFIG.bounds) -> Column:
    """struct(lat, lng, swapped): as given if in bounds, swapped if that is, else nulls."""
    a, b = number(lat), number(lng)
    def within(x, y):
        return x.between(bounds[0], bounds[1]) & y.between(bounds[2], bounds[3])
    return F.when(within(a, b), F.struct(a.alias("lat"), b.alias("lng"), F.lit(False).alias("swapped"))).when(within(b, a), F.struct(b.alias("lat"), a.alias("lng"), F.lit(True).alias("swapped"))).otherwise(
        F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit(False).alias("swapped"))
    )


def sentinel_label(x) -> Column:
    """Names of the failure codes; null for real values."""
    return F.when(_c(x) == -1, "no route").when(_c(x) == -2, "unrealistic").when(_c(x) == -3, "api error")


def valid_minutes(x, most: int = CONFIG.max_minutes) -> Column:
    return F.coalesce(_c(x).between(1, most), F.lit(False))


def duration_minutes(text, most: int = CONFIG.max_minutes) -> Column:
    """'1234s' to whole minutes, truncated; none as -1, beyond bounds as -2."""
    s = F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"^(\d+)(?:\.\d+)?s$", 1)
    m = (s.try_cast("long") / 60).cast("int")
    return F.when(s == "", -1).when((m < 1) | (m > most), -2).otherwise(m)


def last_digits(x) -> Column:
    found = F.regexp_extract(_c(x), r"(\d+)(?!.*\d)", 1)
    return F.when(found != "", found)


def hash_id(url) -> Column:
    return F.concat(F.lit("b:"), F.substring(F.sha1(F.coalesce(_c(url), F.lit("")).cast("binary")), 1, 16))


def amount(x) -> Column:
    """Digits of a price text; hard spaces and letters go."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\D", "").try_cast("long")


def canonical_url(x) -> Column:
    return F.rtrim(F.lower(F.trim(_c(x))), F.lit("/"))


def circle(lat, lng, radius_m, points: int = 64) -> Column:
    """Ring of points + 1 corners (lng, lat) at a distance, by the destination formula."""
    d, p, l = _c(radius_m) / EARTH_M, F.radians(_c(lat)), F.radians(_c(lng))

    def corner(i):
        b = i * (2 * 3.141592653589793 / points)
        q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
        m = l + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
        return F.struct(F.degrees(m).alias("lng"), F.degrees(q).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), corner)
