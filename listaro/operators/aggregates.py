"""Roll-ups, drift, robust statistics and metrics of the listing domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listaro.config import CONFIG, Config
from listaro.functions import scalars as S
from listaro.operators import joins as J
from listaro.operators.places import placed
from listaro.staging import stage

MIN_BATCH, MIN_BASELINE_ROWS, MIN_BASELINE, DROP_FACTOR = 100, 200, 0.05, 0.4
SEVERITY = ("kosmetisk", "mindre", "vesentlig", "alvorlig")


def present(df: DataFrame, column: str) -> Column:
    """Presence is not truth: 0 and false are there; null, empty text and empty lists are not."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    empty = (c == "") if kind == "string" else (F.size(c) == 0) if kind.startswith(("array", "map")) else F.lit(False)
    return c.isNotNull() & ~F.coalesce(empty, F.lit(False))


def fill_rates(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by..., column, rate, n): share of rows with each column present, in one pass; a total of no rows is 0."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(present(df, c)).alias(f"p_{c}") for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p_{c}").alias("p")) for c in columns]))
    return counts.select(*by, "n", pairs.alias("x")).select(*by, F.col("x.column").alias("column"), F.when(F.col("n") > 0, F.col("x.p") / F.col("n")).otherwise(0.0).alias("rate"), "n")


def drift_findings(batch: DataFrame, base: DataFrame, *by: str) -> DataFrame:
    """Columns whose rate fell below DROP_FACTOR of a baseline of MIN_BASELINE or more; nothing where either sample is small."""
    joined = batch.join(base.select("column", F.col("rate").alias("base_rate"), F.col("n").alias("base_n")), "column")
    return joined.filter((F.col("n") >= MIN_BATCH) & (F.col("base_n") >= MIN_BASELINE_ROWS) & (F.col("base_rate") >= MIN_BASELINE) & (F.col("rate") < F.col("base_rate") * DROP_FACTOR)).select(*by, "column", "rate", "base_rate", "n")


def drift_status(batch_n: Column, base_n: Column) -> Column:
    return F.when(batch_n < MIN_BATCH, "skipped:batch").when(base_n < MIN_BASELINE_ROWS, "skipped:baseline").otherwise("checked")


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median) of the values that are not null, exact: those at the middle places, so a key's values are never in one task."""
    counts = stage(df.groupBy(key).agg(F.count(value).alias("n")), "median-counts")
    at = placed(df.filter(F.col(value).isNotNull()).select(key, value), [key], [value], "place_").withColumnRenamed(key, "of_")
    middle = at.join(counts, at["of_"].eqNullSafe(counts[key])).filter(F.col("place_").between(F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2")))
    found = middle.groupBy("of_").agg((F.min(value) + (F.max(value) - F.min(value)) / 2).cast("double").alias("median"))
    return counts.join(found, counts[key].eqNullSafe(found["of_"]), "left").select(counts[key], "n", "median")


def median_mad(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median, mad), exact, by the places of the values and then of their distances from the median; a null key's deviation is not worked out, and is 0."""
    first = stage(medians(df, key, value), "median-first")
    held = first.withColumnRenamed(key, "of_")
    apart = df.join(held, df[key] == held["of_"]).select(df[key], F.abs(df[value] - held["median"]).alias("apart_"))
    spread = medians(apart, key, "apart_").select(F.col(key).alias("of_"), F.col("median").alias("mad"))
    return first.join(spread, first[key].eqNullSafe(spread["of_"]), "left").select(first[key], "n", "median", F.coalesce("mad", F.lit(0.0)).alias("mad"))


def _middle(pairs: Column, k: Column) -> Column:
    """struct(a, b, c): the values at the places k, k + 1 and k + 2 (from 0) of a sorted array of (v, c)."""
    zero = F.struct(F.lit(0).cast("long").alias("seen"), *[F.lit(None).cast("double").alias(c) for c in "abc"])
    return F.aggregate(pairs, zero, lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), *[F.when(s[c].isNull() & (s["seen"] + x["c"] > k + i), x["v"]).otherwise(s[c]).alias(c) for i, c in enumerate("abc")]))


def _among_others(groups: DataFrame, min_abs: float, least: int) -> DataFrame:
    """Each own value of ``groups`` with n and hit: how many others there are, and is the value far from their median?

    ``groups`` has a row per place or postcode; ``hist`` counts all values around it as a sorted array of (v, c, own): own are
    those of the place itself. The others lack one of the row's value, so their median is one of three, and what is apart
    from each is sorted once per place, not per value.
    """
    even, mid, value = F.col("n") % 2 == 0, F.col("mid_"), F.col("value")
    sized = groups.withColumn("n", F.aggregate("hist", F.lit(-1).cast("long"), lambda s, x: s + x["c"])).filter("n > 0").withColumn("k_", F.floor((F.col("n") - 1) / 2)).withColumn("mid_", _middle(F.col("hist"), F.col("k_")))
    pairs = (("a", "b", "a"), ("a", "c", "a"), ("b", "c", "b"))
    sized = sized.withColumn("medians_", F.array(*[(mid[x] + F.when(even, mid[y]).otherwise(mid[z])) / 2.0 for x, y, z in pairs]))
    apart = lambda m: F.array_sort(F.transform("hist", lambda x: F.struct(F.abs(x["v"] - m).alias("v"), x["c"].alias("c"))))
    sized = sized.withColumn("apart_", F.transform("medians_", lambda m: _middle(apart(m), F.col("k_")))).withColumn("own_", F.transform(F.filter("hist", lambda x: x["own"] > 0), lambda x: x["v"])).drop("hist")
    which = F.when(mid["b"] < value, 0).when(mid["a"] < value, 1).otherwise(2)
    lists = sized.withColumn("value", F.explode("own_")).withColumn("which_", which).withColumns({"median": F.get("medians_", F.col("which_")), "far_": F.get("apart_", F.col("which_"))})
    diff, far = F.abs(value - F.col("median")), F.col("far_")
    at = lambda low, high: F.when(far[low] < diff, far[low]).otherwise(far[high])
    mad = (at("a", "b") + F.when(even, at("b", "c")).otherwise(at("a", "b"))) / 2.0
    hit = (F.col("n") >= least) & (diff >= min_abs) & (diff / F.greatest(F.abs("median"), F.lit(1.0)) >= 0.35) & (diff >= 2.5 * F.greatest(mad, F.lit(1.0)))
    return lists.withColumn("hit", hit).drop("k_", "mid_", "medians_", "apart_", "own_", "which_", "far_", "median")


def score_outliers(rows: DataFrame, cfg: Config = CONFIG, threshold: int = 3) -> DataFrame:
    """(id, score, near_n, post_n) of suspicious values: 3 for standing out among neighbours, 2 among the postcode.

    ``rows``: id, value, lat, lng, postcode; one row per donor root. What a row's peers look
    like depends on its place, or postcode, and its value alone, so peers are histograms of
    minutes, worked out once for each such pair: neither a large postcode nor a place of many rows is a self-join.
    """
    at = ["lat", "lng"]
    ok = rows.filter(S.valid_minutes("value")).select("id", F.col("value").cast("double").alias("value"), "lat", "lng", "postcode")
    # At most max_minutes values, whatever the size of the place or the postcode.
    here = ok.filter("lat is not null and lng is not null").groupBy(*at, "value").agg(F.count("*").alias("c")).groupBy(*at).agg(F.collect_list("value").alias("values"), F.collect_list("c").alias("counts"))
    # The peers go to the cells around them, so what is around a place meets in its own cell, and is counted there without a shuffle.
    around = J.radius_join(here, here.select(F.col("lat").alias("peer_lat"), F.col("lng").alias("peer_lng")), cfg.radius_m, 72.0, True)
    own = (F.col("lat") == F.col("peer_lat")) & (F.col("lng") == F.col("peer_lng"))
    cell = ["cell_y", "cell_x", "peer_lat", "peer_lng"]
    each = around.select(*cell, own.alias("own"), F.explode(F.arrays_zip("values", "counts")).alias("x")).groupBy(*cell, F.col("x.values").alias("v")).agg(F.sum("x.counts").alias("c"), F.sum(F.when(F.col("own"), F.col("x.counts")).otherwise(0)).alias("own"))
    hist = F.array_sort(F.collect_list(F.struct("v", "c", "own"))).alias("hist")
    local = _among_others(each.groupBy(*cell).agg(hist), 20.0, 5).select(F.col("peer_lat").alias("lat"), F.col("peer_lng").alias("lng"), "value", F.col("n").alias("near_n"), F.col("hit").alias("near_hit"))
    in_code = ok.filter("postcode is not null and postcode != ''").groupBy("postcode", F.col("value").alias("v")).agg(F.count("*").alias("c")).withColumn("own", F.col("c"))
    post = _among_others(in_code.groupBy("postcode").agg(hist), 25.0, 6).withColumnsRenamed({"n": "post_n", "hit": "post_hit"})
    scored = ok.join(local, [*at, "value"], "left").join(post, ["postcode", "value"], "left")
    score = F.when(F.coalesce("near_hit", F.lit(False)), 3).otherwise(0) + F.when(F.coalesce("post_hit", F.lit(False)), 2).otherwise(0)
    return scored.select("id", score.alias("score"), F.coalesce("near_n", F.lit(0)).alias("near_n"), F.coalesce("post_n", F.lit(0)).alias("post_n")).filter(F.col("score") >= threshold)


def with_donor_distance(scores: DataFrame, rows: DataFrame, donors: DataFrame, radius_m: float, threshold: int = 3) -> DataFrame:
    """Scores with 3 more, and a reason, for rows whose donor is further away than values are reused. ``rows``: id, lat, lng, donor; ``donors``: donor, donor_lat, donor_lng."""
    dist = S.haversine("lat", "lng", "donor_lat", "donor_lng")
    far = rows.join(donors, "donor").withColumn("dist", dist).filter(F.col("dist") > radius_m)
    reason = F.concat(F.lit("Donor: "), F.bround("dist").cast("long").cast("string"), F.lit(f"m > {round(radius_m)}m ("), "donor", F.lit(")"))
    both = scores.join(far.select("id", reason.alias("reason")), "id", "left")
    return both.withColumn("score", F.col("score") + F.when(F.col("reason").isNotNull(), 3).otherwise(0)).filter(F.col("score") >= threshold)


def rollup_findings(findings: DataFrame) -> DataFrame:
    """Per listing: counts by grade, cost bounds and estimate (to 10 000, half up), where costs come from, the worst part.

    Without any cost the bounds are unknown; the worst part is that of the
    highest severity, then cost, then the first.
    """
    known = F.col("kostnad_lav").isNotNull() & F.col("kostnad_hoy").isNotNull()
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("alvorlighet"))
    worst = F.max_by(F.struct("alvorlighet", "bygningsdel"), F.struct(rank, F.coalesce("kostnad_hoy", F.lit(0)), -F.col("pos"), F.col("bygningsdel")))
    sources = F.array_sort(F.collect_set(F.when(known, F.col("kostnad_kilde"))))
    return findings.groupBy("id").agg(
        F.count_if(F.col("tg") == 2).alias("tg2"), F.count_if(F.col("tg") == 3).alias("tg3"),
        F.sum(F.when(known, F.col("kostnad_lav"))).alias("lav"), F.sum(F.when(known, F.col("kostnad_hoy"))).alias("hoy"),
        (F.floor(F.sum(F.when(known, (F.col("kostnad_lav") + F.col("kostnad_hoy")) / 2)) / 10_000 + 0.5) * 10_000).alias("est"),
        F.when(F.size(sources) == 1, sources[0]).when(F.size(sources) > 1, "blandet").alias("kilde"), worst.alias("w"),
    ).select("id", "tg2", "tg3", "lav", "hoy", "est", "kilde", F.col("w.alvorlighet").alias("alvorlighet"), F.col("w.bygningsdel").alias("verste"))


def snapshot_diff(before: DataFrame, now: DataFrame, sold: DataFrame) -> DataFrame:
    """(id, change) for added, removed_sold and removed_delisted."""
    removed = before.join(now, "id", "left_anti")
    return (
        now.join(before, "id", "left_anti").select("id", F.lit("added").alias("change"))
        .unionByName(removed.join(sold, "id", "left_semi").select("id", F.lit("removed_sold").alias("change")))
        .unionByName(removed.join(sold, "id", "left_anti").select("id", F.lit("removed_delisted").alias("change")))
    )


def status_changes(observations: DataFrame) -> DataFrame:
    """Rows whose trimmed status differs from the one before of the same id; null as empty."""
    clean = F.trim(F.coalesce("status", F.lit("")))
    w = Window.partitionBy("id").orderBy("observed_at", "event_id")
    rows = observations.withColumn("new_status", clean).withColumn("old_status", F.lag("new_status").over(w))
    return rows.filter("old_status is not null and old_status != new_status").select("id", "event_id", "old_status", "new_status")


def apply_budget(calls: DataFrame, cap: int) -> DataFrame:
    """Each call with its place in its api and month, and whether the cap let it through; blocked calls are not counted.

    An api's month goes over as many tasks as its calls need, see ``placed``.
    """
    counted = calls.filter("outcome != 'blocked'").withColumn("month", F.date_format("called_at", "yyyy-MM"))
    return placed(counted, ["api", "month"], ["called_at", "event_id"]).withColumn("allowed", F.col("place") <= cap)


def budget_warnings(calls: DataFrame, cap: int, percents: tuple[int, ...] = (50, 80, 100)) -> DataFrame:
    """The first call at which each share of the cap is reached, once per api and month."""
    placed = apply_budget(calls, cap).withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents])))
    reached = placed.filter(F.col("place") * 100 >= F.col("pct") * cap)
    return reached.groupBy("api", "month", "pct").agg(F.min("place").alias("place"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Values with counts; unknown is the value ""."""
    return df.groupBy(F.coalesce(F.trim(column), F.lit("")).alias("value")).agg(F.count("*").alias("n"))


def band_accuracy(stated: DataFrame, estimated: DataFrame, *by: str) -> DataFrame:
    """Stated and estimated costs of each key paired by rank: exact, higher, lower and unmatched counts."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy("cost", "pos", "part"))).select(*by, "rk", F.col("cost").alias(name))

    both = ranked(stated, "stated").join(ranked(estimated, "estimated"), [*by, "rk"], "full")
    return both.agg(
        F.count_if(F.col("stated") == F.col("estimated")).alias("exact"), F.count_if(F.col("estimated") > F.col("stated")).alias("higher"),
        F.count_if(F.col("estimated") < F.col("stated")).alias("lower"), F.count_if(F.col("stated").isNull() | F.col("estimated").isNull()).alias("unmatched"),
    )
