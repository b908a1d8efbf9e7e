"""Robust means and trends, and tests for a change of the mean at a known or unknown date.

Every test works on all series of a table at once: one window by series for positions and
running sums, one aggregation by series for the ordered arrays that standard errors need.
Both are partitioned by series_id, so the joins between them move nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waneline.functions import model, stats
from waneline.functions.errors import InputError
from waneline.operators import align

MIN_OBS = 20
MIN_SIDE = 5


def arrays(df: DataFrame, *extra: str) -> DataFrame:
    """One row per series: n, the values y in date order, their dates d, and further columns likewise."""
    rows = align.dropna(df).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("date", "value", *extra))).alias("_r"))
    return rows.select("series_id", F.size("_r").alias("n"), F.col("_r.value").alias("y"), F.col("_r.date").alias("d"), *[F.col(f"_r.{c}").alias(c) for c in extra])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def hac_mean(df: DataFrame, hac_lags: int | None = None, min_lags: int | None = None) -> DataFrame:
    """series_id, n, mean, se, t, lags: Newey-West errors without small-sample correction."""
    floor = min_lags if min_lags is not None else (model.window_of(df) or 1) - 1
    a = arrays(df).withColumns({"mean": mean(F.col("y")), "lags": stats.lags(F.col("n"), hac_lags, floor)})
    z = F.transform("y", lambda v: (v - F.col("mean")) / F.col("n"))
    a = a.withColumn("se", stats.se(z, F.col("lags")))
    return a.select("series_id", F.col("n").cast("long").alias("n"), "mean", "se", (F.col("mean") / F.col("se")).alias("t"), "lags")


def hac_line(df: DataFrame, x: str = "t", hac_lags: int | None = None, min_lags: int = 0) -> DataFrame:
    """series_id, n, intercept, slope and their Newey-West t for value on [1, x]; null slope for constant x."""
    a = arrays(df, x).withColumns({"mx": mean(F.col(x)), "my": mean(F.col("y")), "lags": stats.lags(F.col("n"), hac_lags, min_lags)})
    a = a.withColumn("sxx", total(F.transform(x, lambda v: (v - F.col("mx")) * (v - F.col("mx")))))
    a = a.withColumn("slope", total(F.zip_with(x, "y", lambda u, v: (u - F.col("mx")) * (v - F.col("my")))) / F.nullif("sxx", F.lit(0.0)))
    a = a.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    u = F.zip_with(x, "y", lambda p, v: v - F.col("intercept") - F.col("slope") * p)
    a = a.withColumn("u", u)
    zs = F.zip_with(x, "u", lambda p, e: (p - F.col("mx")) / F.col("sxx") * e)
    zi = F.zip_with(x, "u", lambda p, e: (F.lit(1.0) / F.col("n") - F.col("mx") * (p - F.col("mx")) / F.col("sxx")) * e)
    a = a.withColumns({"se_slope": F.when(F.col("sxx") > 0, stats.se(zs, F.col("lags"))), "se_intercept": F.when(F.col("sxx") > 0, stats.se(zi, F.col("lags")))})
    return a.select("series_id", F.col("n").cast("long").alias("n"), "intercept", "slope", (F.col("intercept") / F.col("se_intercept")).alias("t_intercept"), (F.col("slope") / F.col("se_slope")).alias("t_slope"), "lags")


def shift(a: DataFrame, k: str = "k") -> DataFrame:
    """Adds mean_before, mean_after, change and change_t of a mean shift at position k to a table of arrays with lags."""
    n, at = F.col("n"), F.col(k)
    a = a.withColumns({"mean_before": mean(F.slice("y", F.lit(1), at)), "mean_after": mean(F.slice("y", at + 1, n - at))})
    z = F.transform("y", lambda v, i: F.when(i < at, -(v - F.col("mean_before")) / at).otherwise((v - F.col("mean_after")) / (n - at)))
    a = a.withColumn("change", F.col("mean_after") - F.col("mean_before"))
    return a.withColumn("change_t", F.col("change") / stats.se(z, F.col("lags")))


RESULT = ("series_id", "date", "stat", "p_value", "mean_before", "mean_after", "change", "change_t", "n_before", "n_after", "hac_lags")


def _result(a: DataFrame) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    return a.withColumns({"date": F.element_at("d", k + 1), "n_before": k.cast("long"), "n_after": (n - k).cast("long"), "hac_lags": F.col("lags")}).select(*RESULT)


def _usable(a: DataFrame) -> DataFrame:
    """Series of 20 values or more that are not constant; ``too_short`` reports the rest."""
    return a.filter((F.col("n") >= MIN_OBS) & (F.array_max("y") > F.array_min("y")))


def unusable(df: DataFrame) -> DataFrame:
    """Diagnostics: series that the tests leave out."""
    a = arrays(df)
    kind = F.when(F.col("n") < MIN_OBS, "too_short").when(F.array_max("y") == F.array_min("y"), "constant")
    return a.withColumn("kind", kind).filter("kind is not null").select("series_id", "kind", F.col("n").cast("long").alias("count"), F.concat(F.lit("left out: "), F.col("kind")).alias("message"))


def chow_test(df: DataFrame, date: str | dt.date, hac_lags: int | None = None) -> DataFrame:
    """Wald test of a mean shift from a known date on; series with under 5 values on a side are left out."""
    when = model.need_date("date", date)
    floor = (model.window_of(df) or 1) - 1
    a = _usable(arrays(df)).withColumns({"lags": stats.lags(F.col("n"), hac_lags, floor), "k": F.size(F.filter("d", lambda x: x < F.lit(when)))})
    a = shift(a.filter((F.col("k") >= MIN_SIDE) & (F.col("n") - F.col("k") >= MIN_SIDE)))
    a = a.withColumn("stat", F.col("change_t") * F.col("change_t"))
    return _result(a.withColumn("p_value", stats.chi2_sf(F.col("stat"))))


def _long_run(a: DataFrame) -> DataFrame:
    """Adds the mean and the long-run variance of deviations from it (at least 1e-300)."""
    a = a.withColumn("mean", mean(F.col("y")))
    e = F.transform("y", lambda v: v - F.col("mean"))
    return a.withColumn("lrv", F.greatest(stats.bartlett(e, F.col("lags")) / F.col("n"), F.lit(1e-300)))


def _running(df: DataFrame, a: DataFrame) -> DataFrame:
    """Rows of usable series with position, running sum, mean and long-run variance."""
    w = Window.partitionBy("series_id").orderBy("date")
    rows = align.dropna(df).select("series_id", "date", "value").withColumns({"i": F.row_number().over(w) - 1, "csum": F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.join(a.select("series_id", "n", "mean", "lrv", "lags"), "series_id")


def sup_wald_path(df: DataFrame, trim: float = 0.15, hac_lags: int | None = None) -> DataFrame:
    """series_id, date, k, wald at every candidate: k values before, the date begins the new regime."""
    if trim not in stats.SUP_WALD_TRIMS:
        raise InputError(f"trim must be one of {stats.SUP_WALD_TRIMS}, got {trim!r}.")
    floor = (model.window_of(df) or 1) - 1
    a = _long_run(_usable(arrays(df)).withColumn("lags", stats.lags(F.col("n"), hac_lags, floor)))
    n = F.col("n")
    rows = _running(df, a).withColumns({"k": F.col("i"), "before": F.col("csum") - F.col("value"), "all": F.col("mean") * n})
    lo = F.greatest(F.ceil(F.lit(trim) * n), F.lit(MIN_SIDE))
    hi = F.least(F.floor((1.0 - F.lit(trim)) * n), n - MIN_SIDE)
    rows = rows.filter((F.col("k") >= lo) & (F.col("k") <= hi))
    gap = (F.col("all") - F.col("before")) / (n - F.col("k")) - F.col("before") / F.col("k")
    wald = gap * gap / (F.col("lrv") * (F.lit(1.0) / F.col("k") + F.lit(1.0) / (n - F.col("k"))))
    return rows.select("series_id", "date", F.col("k").cast("int").alias("k"), wald.alias("wald"))


def _at_best(df: DataFrame, best: DataFrame, hac_lags: int | None) -> DataFrame:
    floor = (model.window_of(df) or 1) - 1
    a = arrays(df).withColumn("lags", stats.lags(F.col("n"), hac_lags, floor)).join(best, "series_id")
    return shift(a)


def sup_wald(df: DataFrame, trim: float = 0.15, hac_lags: int | None = None) -> DataFrame:
    """Search for the date of a mean shift; the first of equal statistics wins."""
    path = sup_wald_path(df, trim, hac_lags)
    best = path.groupBy("series_id").agg(F.max(F.struct("wald", (-F.col("k")).alias("neg"))).alias("_b")).select("series_id", F.col("_b.wald").alias("stat"), (-F.col("_b.neg")).alias("k"))
    return _result(_at_best(df, best, hac_lags).withColumn("p_value", stats.sup_wald_p(F.col("stat"), trim)))


def cusum_path(df: DataFrame, hac_lags: int | None = None) -> DataFrame:
    """series_id, date, i, cusum: running sum of deviations over the long-run deviation times sqrt(n)."""
    floor = (model.window_of(df) or 1) - 1
    a = _long_run(_usable(arrays(df)).withColumn("lags", stats.lags(F.col("n"), hac_lags, floor)))
    rows = _running(df, a)
    c = (F.col("csum") - (F.col("i") + 1) * F.col("mean")) / (F.sqrt("lrv") * F.sqrt("n"))
    return rows.select("series_id", "date", F.col("i").cast("int").alias("i"), F.col("n").alias("n"), c.alias("cusum"))


def cusum(df: DataFrame, hac_lags: int | None = None) -> DataFrame:
    """CUSUM test; the break follows the first largest excursion before the last date."""
    path = cusum_path(df, hac_lags).withColumn("_a", F.abs("cusum"))
    inner = F.when(F.col("i") < F.col("n") - 1, F.struct("_a", (-F.col("i")).alias("neg")))
    best = path.groupBy("series_id").agg(F.max("_a").alias("stat"), F.max(inner).alias("_b")).select("series_id", "stat", (-F.col("_b.neg") + 1).cast("int").alias("k"))
    a = _at_best(df, best, hac_lags)
    one_sided = F.least(F.col("k"), F.col("n") - F.col("k")) < 2
    a = a.withColumns({"change": F.when(~one_sided, F.col("change")), "change_t": F.when(~one_sided, F.col("change_t"))})
    return _result(a.withColumn("p_value", stats.kolmogorov_sf(F.col("stat"))))


def find_break(df: DataFrame, method: str = "sup_wald", trim: float = 0.15, hac_lags: int | None = None) -> DataFrame:
    """Search by ``sup_wald`` or ``cusum``."""
    model.need_choice("method", method, ("sup_wald", "cusum"))
    return sup_wald(df, trim, hac_lags) if method == "sup_wald" else cusum(df, hac_lags)


def significant(result: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The result with n_obs and whether the break is significant."""
    return result.withColumns({"n_obs": F.col("n_before") + F.col("n_after"), "significant": F.col("p_value") < alpha})
