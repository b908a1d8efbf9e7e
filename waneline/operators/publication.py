"""The gap between in-sample, post-sample and post-publication performance."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waneline.functions import model, stats
from waneline.functions.errors import InputError
from waneline.operators import align, breaks

PERIODS = ("in_sample", "post_sample", "post_publication")
MIN_IN_SAMPLE = 12
MIN_T_OBS = 12


def _split(df: DataFrame, sample_end: dt.date, publication: dt.date, sample_start: dt.date | None) -> DataFrame:
    p = F.when(F.col("date") <= F.lit(sample_end), 0).when(F.col("date") < F.lit(publication), 1).otherwise(2)
    rows = align.dropna(df) if sample_start is None else align.dropna(df).filter(F.col("date") >= F.lit(sample_start))
    return rows.withColumn("p", p)


def _dates(sample_end, publication_date, sample_start) -> tuple[dt.date, dt.date, dt.date | None]:
    end, pub = model.need_date("sample_end", sample_end), model.need_date("publication_date", publication_date)
    if pub <= end:
        raise InputError(f"publication_date ({pub}) must be after sample_end ({end}).")
    start = None if sample_start is None else model.need_date("sample_start", sample_start)
    if start is not None and start >= end:
        raise InputError("sample_start must be before sample_end.")
    return end, pub, start


def _groups(df: DataFrame, end: dt.date, pub: dt.date, start: dt.date | None, hac_lags: int | None) -> DataFrame:
    """Arrays of each usable series with period means m0, m1, m2, sizes n0, n1, n2, residual array u and lags."""
    floor = (model.window_of(df) or 1) - 1
    a = breaks.arrays(_split(df, end, pub, start), "p").withColumn("lags", stats.lags(F.col("n"), hac_lags, floor))
    of = lambda k: F.filter("y", lambda _, i: F.element_at("p", i + 1) == k)
    for k in range(3):
        a = a.withColumns({f"y{k}": of(k)}).withColumns({f"n{k}": F.size(f"y{k}"), f"m{k}": breaks.mean(F.col(f"y{k}"))})
    a = a.filter((F.col("n0") >= MIN_IN_SAMPLE) & (F.col("n2") >= 1))
    own = lambda p: F.when(p == 0, F.col("m0")).when(p == 1, F.col("m1")).otherwise(F.col("m2"))
    return a.withColumn("u", F.zip_with("y", "p", lambda v, p: v - own(p)))


def _gap_t(a: str, b: str) -> Column:
    """Newey-West t of mean b less mean a, period numbers as text."""
    z = F.zip_with("p", "u", lambda p, u: F.when(p == int(b), u / F.col(f"n{b}")).when(p == int(a), -u / F.col(f"n{a}")).otherwise(0.0))
    return (F.col(f"m{b}") - F.col(f"m{a}")) / stats.se(z, F.col("lags"))


def publication_gap(df: DataFrame, sample_end: str | dt.date, publication_date: str | dt.date, sample_start: str | dt.date | None = None, hac_lags: int | None = None) -> DataFrame:
    """One row per series: in-sample mean, changes after it with robust t, declines, and the contrast of the two later periods.

    Series with fewer than 12 in-sample values or none after publication are left out.
    Without a post-sample period its columns are null.
    """
    end, pub, start = _dates(sample_end, publication_date, sample_start)
    a = _groups(df, end, pub, start, hac_lags)
    some = F.col("n1") > 0
    decline = lambda c: F.when(F.col("m0") > 0, -c / F.col("m0"))
    post, after = F.col("m1") - F.col("m0"), F.col("m2") - F.col("m0")
    return a.select(
        "series_id",
        F.col("m0").alias("in_sample_mean"),
        F.when(some, post).alias("post_sample_change"),
        F.when(some, _gap_t("0", "1")).alias("post_sample_t"),
        after.alias("post_publication_change"),
        _gap_t("0", "2").alias("post_publication_t"),
        F.when(some, _gap_t("1", "2")).alias("publication_vs_post_sample_t"),
        F.when(some, decline(post)).alias("post_sample_decline"),
        decline(after).alias("post_publication_decline"),
        F.col("lags").alias("hac_lags"),
    )


def publication_table(df: DataFrame, sample_end: str | dt.date, publication_date: str | dt.date, sample_start: str | dt.date | None = None, freq: str | None = None, hac_lags: int | None = None) -> DataFrame:
    """Three rows per series: start, end, n_obs, mean, ann_mean, ann_sharpe, t_stat, decline; an empty period keeps its row."""
    end, pub, start = _dates(sample_end, publication_date, sample_start)
    ppy = model.PERIODS_PER_YEAR[align.resolve_freq(df, freq)]
    floor = (model.window_of(df) or 1) - 1
    a = _groups(df, end, pub, start, hac_lags)
    zipped = lambda k: F.filter(F.arrays_zip("d", "p"), lambda r: r["p"] == k)
    rows = []
    for k, name in enumerate(PERIODS):
        d = F.transform(zipped(k), lambda r: r["d"])
        rows.append(F.struct(F.lit(name).alias("period"), F.lit(k).alias("k"), F.array_min(d).alias("start"), F.array_max(d).alias("end"), F.col(f"n{k}").alias("n"), F.col(f"y{k}").alias("y"), F.col(f"m{k}").alias("mean")))
    x = a.select("series_id", "m0", F.col("lags").alias("all"), F.explode(F.array(*rows)).alias("r")).select("series_id", "m0", "all", "r.*")
    n, m = F.col("n"), F.col("mean")
    lag = F.least(F.col("all"), n - 1) if hac_lags is not None else stats.lags(n, None, floor)
    x = x.withColumn("lags", F.greatest(lag, F.lit(0)).cast("int"))
    sd = F.when(n > 1, F.sqrt(breaks.total(F.transform("y", lambda v: (v - m) * (v - m))) / (n - 1)))
    se = stats.se(F.transform("y", lambda v: (v - m) / n), F.col("lags"))
    return x.select(
        "series_id", "period", "start", "end", n.cast("long").alias("n_obs"), "mean", (m * ppy).alias("ann_mean"),
        F.when(sd > 0, m / sd * math.sqrt(ppy)).alias("ann_sharpe"), F.when(n >= MIN_T_OBS, m / se).alias("t_stat"),
        F.when(F.col("k") == 0, F.lit(0.0)).when((n > 0) & (F.col("m0") > 0), -(m - F.col("m0")) / F.col("m0")).alias("decline"),
    )
