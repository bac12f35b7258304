"""Published tables: pinned columns, cells as text or numbers, nested payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.functions import scalars as S

#: The columns of the published listing table, in order.
HEADER = ("id", "status", "adresse", "postnummer", "pris", "pris_kvm", "bra_i", "bra_total", "byggeaar", "boligtype", "eieform", "energimerke", "brj", "mvv", "url", "image_url")
_TEXT = {"id", "status", "adresse", "boligtype", "eieform", "energimerke", "url", "image_url"}
_ZERO = {"pris", "pris_kvm"}


def published(df: DataFrame) -> DataFrame:
    """The pinned columns: text cells cleaned, prices 0 where unknown, other numbers as text, "" where unknown."""
    def make(c: str):
        if c == "postnummer":
            return S.padded_postcode(c)
        if c in _ZERO:
            return S.int_or_zero(c)
        return S.cell(c) if c in _TEXT else F.coalesce(S.rounded(c).cast("string"), F.lit(""))

    return df.select(*[make(c).alias(c) for c in HEADER])


#: The headers of the full listing sheet, in order, and the columns that they show; None: not held, so always empty.
SHEET = {
    "Finnkode": "id", "Tilgjengelighet": "status", "active": "active", "ADRESSE": "adresse", "Postnummer": "postnummer", "Pris": "pris", "URL": "url", "IMAGE_URL": "image_url",
    "IMAGE_HOSTED_URL": None, "Bruksareal": "bra_total", "Internt bruksareal (BRA-i)": "bra_i", "Primærrom": "bra_primary", "Bruttoareal": None,
    "Eksternt bruksareal (BRA-e)": None, "Innglasset balkong (BRA-b)": None, "Balkong/Terrasse (TBA)": None, "Tomteareal": None, "Eierskap, tomt": "eieform", "Boligtype": "boligtype",
    "Byggeår": "byggeaar", "LAT": "lat", "LNG": "lng", "PRIS KVM": "pris_kvm", "PENDL RUSH BRJ": "brj", "PENDL RUSH MVV": "mvv", "MVV UNI RUSH": None,
    "TRAVEL_COPY_FROM_FINNKODE": "donor", "GOOGLE_MAPS_URL": "maps_url", "SCRAPED_AT": "scraped_at", "Kommentar": "comment", "Tag": "tag",
}
#: Headers whose numbers are 0 where unknown, and those that are empty.
SHEET_ZERO = ("Pris", "PRIS KVM")
SHEET_NUMBERS = ("Bruksareal", "Internt bruksareal (BRA-i)", "Primærrom", "Bruttoareal", "Eksternt bruksareal (BRA-e)", "Innglasset balkong (BRA-b)", "Balkong/Terrasse (TBA)", "Tomteareal", "Byggeår", "PENDL RUSH BRJ", "PENDL RUSH MVV", "MVV UNI RUSH")


def sheet(df: DataFrame) -> DataFrame:
    """The full sheet: every header in its place, cells by their class; a column that ``df`` lacks is empty."""
    def make(header: str, c: str | None):
        if c is None or c not in df.columns:
            return F.lit("")
        if header in SHEET_ZERO:
            return S.int_or_zero(c)
        if header in SHEET_NUMBERS:
            return F.coalesce(S.rounded(c).cast("string"), F.lit(""))
        return S.padded_postcode(c) if c == "postnummer" else S.cell(c)

    return df.select(*[make(h, c).alias(h) for h, c in SHEET.items()])


def station_table(stations: DataFrame, lines: DataFrame, travel: DataFrame, destinations: list[str]) -> DataFrame:
    """A row per station and line, a column per destination, all as text."""
    rows = stations.join(lines, "station_id", "left")
    wide = travel.groupBy("station_id", "line").pivot("destination", destinations).agg(F.min("minutes"))
    return rows.join(wide, ["station_id", "line"], "left").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("station_id", "name", "line", *destinations)])


def station_summary(stations: DataFrame, lines: DataFrame, travel: DataFrame) -> DataFrame:
    """Lines and least minutes per destination of each station; an unknown time never beats a known one."""
    by_line = lines.groupBy("station_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    least = travel.groupBy("station_id", "destination").agg(F.min("minutes").alias("m")).groupBy("station_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("destination", "m")))).alias("minutes"))
    return stations.select("station_id", "name").join(by_line, "station_id", "left").join(least, "station_id", "left")


def all_listings(*buckets: tuple[str, DataFrame]) -> DataFrame:
    """The buckets in one table, columns by name, missing ones null."""
    out = None
    for name, df in buckets:
        part = df.withColumn("bucket", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def payload(df: DataFrame, travel: tuple[str, ...] = ("brj", "mvv")) -> DataFrame:
    """Listings as nested rows: a map of travel minutes, lists of children."""
    minutes = F.map_from_arrays(F.array(*[F.lit(t) for t in travel]), F.array(*[F.col(t) for t in travel]))
    return df.withColumn("travel", minutes).drop(*travel)


def publish_all(builders: dict[str, Callable[[], DataFrame]], write: Callable[[str, DataFrame], None]) -> dict[str, list[str]]:
    """Write each table; a failure stops the run and is reported with what was done and what was not tried."""
    names = list(builders)
    for i, name in enumerate(names):
        try:
            write(name, builders[name]())
        except Exception as problem:  # noqa: BLE001  whatever a writer raises is reported
            return {"done": names[:i], "failed": [name, str(problem)], "untried": names[i + 1 :]}
    return {"done": names, "failed": [], "untried": []}
