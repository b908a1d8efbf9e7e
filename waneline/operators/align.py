"""Alignment: calendars, trimming, frequency inference, elapsed years, panel overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waneline.functions import model
from waneline.functions.errors import AlignmentError, FrequencyError


def calendar(panel: DataFrame) -> DataFrame:
    """Distinct dates of a panel with a dense position ``i`` from 0.

    Shifts count dates, not an asset's own rows, so a missing cell never moves a return. Dates
    are few (a row per period), so one window over them is one small task.
    """
    return panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def dropna(df: DataFrame) -> DataFrame:
    """Non-missing rows of a series table; leading and trailing gaps go silently (see ``dropped``)."""
    return df.filter(F.col("value").isNotNull())


def dropped(df: DataFrame) -> DataFrame:
    """Diagnostics: number of missing rows between the first and last value of each series."""
    w = Window.partitionBy("series_id")
    there = F.when(F.col("value").isNotNull(), F.col("date"))
    marked = df.withColumns({"_first": F.min(there).over(w), "_last": F.max(there).over(w)})
    inner = marked.filter(F.col("value").isNull() & (F.col("date") > F.col("_first")) & (F.col("date") < F.col("_last")))
    out = inner.groupBy("series_id").agg(F.count(F.lit(1)).alias("count"))
    return out.select("series_id", F.lit("interior_missing").alias("kind"), "count", F.concat(F.lit("dropped "), F.col("count").cast("string"), F.lit(" missing value(s) inside the sample")).alias("message"))


def years(date: Column, start: Column) -> Column:
    """Elapsed years of 365.25 days."""
    return F.datediff(date, start) / F.lit(model.DAYS_PER_YEAR)


def years_since_start(df: DataFrame) -> DataFrame:
    """The table with ``t``, years since the first row of each series."""
    return df.withColumn("t", years(F.col("date"), F.min("date").over(Window.partitionBy("series_id"))))


def infer_freq(df: DataFrame) -> DataFrame:
    """series_id, freq, median_gap, off_band_share; freq is null where dates are too few or irregular.

    The median gap picks a band, and gaps outside it may take 5 % of the time span at most.
    """
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("series_id").orderBy("date"))).cast("double")
    gaps = df.select("series_id", "date").distinct().withColumn("gap", gap)
    w = Window.partitionBy("series_id")
    gaps = gaps.withColumn("_m", F.median("gap").over(w))
    band = F.coalesce(*[F.when(F.col("_m").between(lo, hi), F.lit(f)) for f, (lo, hi) in model.FREQ_BANDS.items()])
    off = F.coalesce(*[F.when(F.col("_b") == f, ~F.col("gap").between(lo, hi)) for f, (lo, hi) in model.FREQ_BANDS.items()])
    out = gaps.withColumn("_b", band).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("median_gap"), F.max("_b").alias("_b"), F.sum(F.when(off, F.col("gap")).otherwise(0.0)).alias("_off"), F.sum("gap").alias("_all"))
    share = F.when(F.col("_b").isNotNull(), F.col("_off") / F.nullif("_all", F.lit(0.0)))
    ok = (F.col("n") >= 3) & F.col("_b").isNotNull() & (share <= model.MAX_OFF_BAND)
    return out.select("series_id", F.when(ok, F.col("_b")).alias("freq"), "median_gap", share.alias("off_band_share"))


def resolve_freq(df: DataFrame, freq: str | None) -> str:
    """The given frequency, or the one that all series of the table share; an error if there is none."""
    if freq is not None:
        return model.parse_freq(freq)
    found = infer_freq(df).select("freq").distinct().limit(2).collect()
    if len(found) != 1 or found[0]["freq"] is None:
        raise FrequencyError("The dates have no single regular frequency. Pass freq= (D, W, M, Q or A) or fix the dates.")
    return found[0]["freq"]


def same_freq(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("left", "right")) -> str:
    """The frequency of both tables; an error if they differ."""
    x, y = resolve_freq(a, None), resolve_freq(b, None)
    if x != y:
        raise FrequencyError(f"{names[0]} is {x} and {names[1]} is {y}; resample one of them.")
    return x


def align_panels(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """date, asset_id and both values, for dates and assets that both panels have; none in common is an error."""
    need_overlap(left, right)
    dates = left.select("date").distinct().join(right.select("date").distinct(), "date")
    assets = left.select("asset_id").distinct().join(right.select("asset_id").distinct(), "asset_id")
    both = left.withColumnRenamed("value", names[0]).join(right.withColumnRenamed("value", names[1]), ["date", "asset_id"], "full")
    return both.join(dates, "date", "left_semi").join(assets, "asset_id", "left_semi").select("date", "asset_id", *names)


def excluded(left: DataFrame, right: DataFrame) -> DataFrame:
    """Diagnostics of ``align_panels``: dates and assets that only one panel has."""
    parts = []
    for key in ("date", "asset_id"):
        a, b = left.select(key).distinct(), right.select(key).distinct()
        for side, only in (("left", a.exceptAll(b)), ("right", b.exceptAll(a))):
            parts.append(only.agg(F.count(F.lit(1)).alias("count")).select(F.lit(side).alias("series_id"), F.lit(f"excluded_{key}").alias("kind"), "count", F.lit(f"{key} values of one panel only").alias("message")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def need_overlap(left: DataFrame, right: DataFrame) -> None:
    """An error if the panels share no date or no asset; an empty panel has nothing to share and passes."""
    common = lambda key: left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi").limit(1).select(F.lit(key).alias("key"))
    found = {r["key"] for r in common("date").unionAll(common("asset_id")).collect()}  # one job for both
    for key in ("date", "asset_id"):
        if key not in found and not (left.isEmpty() or right.isEmpty()):
            raise AlignmentError(f"The panels share no {key}. Check that both use the same labels.")
