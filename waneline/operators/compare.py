"""Many signals at once: corrected comparison, walk-forward stability, and IC by horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waneline.functions import model
from waneline.functions.errors import InputError, InsufficientDataError
from waneline.operators import align, breaks, decay, panel

LN2 = 0.6931471805599453


def adjust(df: DataFrame, method: str = "holm", p: str = "p_value", out: str = "p_adjusted", key: str = "series_id") -> DataFrame:
    """The table with p-values corrected over all its rows: ``holm``, ``bh`` or ``none``.

    A row per signal: the window has no partition, and holds as many rows as there are signals.
    """
    model.need_choice("adjust", method, ("holm", "bh", "none"))
    if method == "none":
        return df.withColumn(out, F.col(p))
    order = Window.orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    k = F.row_number().over(order)
    if method == "holm":
        stepped = df.withColumn("_s", F.col(p) * (m - k + 1))
        best = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        stepped = df.withColumn("_s", F.col(p) * m / k)
        best = F.min("_s").over(order.rowsBetween(0, Window.unboundedFollowing))
    return stepped.withColumn(out, F.least(F.lit(1.0), best)).drop("_s")


def compare_signals(df: DataFrame, n_boot: int = 1000, alpha: float = 0.05, method: str = "holm", seed: int = 0) -> DataFrame:
    """Fits of all series with corrected p-values and a rank: detected ones by half-life, then the rest by p-value.

    Short and constant series are left out; two usable ones are needed.
    """
    need_two(df)
    fits = adjust(decay.fit_decay(df, n_boot, alpha, None, seed), method)
    order = Window.orderBy((~F.col("decay_detected")).cast("int"), F.when(F.col("decay_detected"), F.col("half_life_years")).otherwise(F.col("p_value")), "series_id")
    return fits.select(
        "series_id", "decay_rate", "half_life_years", "ci_low", "ci_high", "p_value", "p_adjusted", "decay_detected",
        ((F.col("p_adjusted") < alpha) & F.col("decay_detected")).alias("decay_detected_adjusted"), "n_obs", "start", "end", "model", F.row_number().over(order).cast("long").alias("rank"),
    )


def need_two(df: DataFrame) -> None:
    """An error unless two series or more can be compared."""
    if decay.usable(breaks.arrays(df)).limit(2).count() < 2:
        raise InsufficientDataError("At least two usable series are needed to compare.")


def walk_forward(df: DataFrame, min_obs: int = 60, step: int = 12, n_boot: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Fits on the first min_obs, min_obs + step, ... and all values of each series: a row per prefix.

    A prefix is a slice of its series' arrays, dealt out on its own, so prefixes of one series
    are fitted in parallel. Later values never change an earlier row.
    """
    model.need_int("min_obs", min_obs, decay.MIN_OBS)
    model.need_int("step", step, 1)
    window = model.window_of(df) or 1
    a = decay.usable(breaks.arrays(df)).filter(F.col("n") >= min_obs)
    ends = F.array_distinct(F.concat(F.sequence(F.lit(min_obs), F.col("n"), F.lit(step)), F.array("n")))
    cut = a.select("series_id", F.explode(ends).alias("k"), "y", "d").select(F.concat("series_id", F.lit("\x1f"), F.col("k").cast("string")).alias("series_id"), F.slice("y", F.lit(1), F.col("k")).alias("y"), F.slice("d", F.lit(1), F.col("k")).alias("d"))
    cut = cut.filter(F.array_max("y") > F.array_min("y"))
    fits = decay.fit_arrays(cut, n_boot, alpha, None, window, seed)
    return fits.select(
        F.split("series_id", "\x1f")[0].alias("series_id"), F.col("end").alias("date"), "n_obs", "decay_rate", "half_life_years", "ci_low", "ci_high", "p_value", "decay_detected", "model", "fallback"
    )


def walk_forward_stability(table: DataFrame) -> DataFrame:
    """share_detected, stable_since and half_life_drift of each series of a walk-forward table."""
    last_miss = F.max(F.when(~F.col("decay_detected"), F.col("n_obs")))
    a = table.groupBy("series_id").agg(
        F.avg(F.col("decay_detected").cast("double")).alias("share_detected"), last_miss.alias("_miss"), F.max("n_obs").alias("_n"),
        F.array_sort(F.collect_list(F.struct("n_obs", "date"))).alias("_e"),
        F.count("half_life_years").alias("_k"), F.median("half_life_years").alias("_med"), (F.max("half_life_years") - F.min("half_life_years")).alias("_range"),
    )
    after = F.filter("_e", lambda e: F.col("_miss").isNull() | (e["n_obs"] > F.col("_miss")))
    return a.select("series_id", "share_detected", F.array_min(after["date"]).alias("stable_since"), F.when((F.col("_k") >= 2) & (F.col("_med") > 0), F.col("_range") / F.col("_med")).alias("half_life_drift"))


MIN_DATES = 10


def check_horizons(horizons: Sequence[int]) -> list[int]:
    """Unique positive horizons in order."""
    hs = [model.need_int("horizon", h, 1) for h in horizons]
    if not hs or len(set(hs)) != len(hs):
        raise InputError("horizons must be a non-empty list of different positive integers.")
    return sorted(hs)


def ic_by_horizon(signal: DataFrame, returns: DataFrame, horizons: Sequence[int] = (1, 2, 3, 6, 12), method: str = "spearman", min_assets: int = 5, hac_lags: int | None = None) -> DataFrame:
    """horizon, mean_ic, t_stat, n_dates, ic_per_period; robust errors cover the overlap of h-period returns.

    Forward returns are built on the whole return calendar before they meet the signal, and
    all horizons go through one plan. Horizons with fewer than ten usable dates are left out.
    """
    hs = check_horizons(horizons)
    align.need_overlap(signal, returns)  # forward returns have the same dates and assets
    fwd = None
    for h in hs:
        f = panel.forward_returns(returns, h, check=h == hs[0]).withColumn("horizon", F.lit(h))
        fwd = f if fwd is None else fwd.unionByName(f)
    ic = panel.ic_series(signal, fwd, method, min_assets, ("horizon",), check=False).filter("value is not null")
    from waneline.functions import stats

    a = breaks.arrays(ic.select(F.col("horizon").cast("string").alias("series_id"), "date", "value")).withColumn("horizon", F.col("series_id").cast("int"))
    a = a.filter(F.col("n") >= MIN_DATES).withColumns({"mean_ic": breaks.mean(F.col("y")), "lags": stats.lags(F.col("n"), hac_lags, F.col("horizon") - 1)})
    z = F.transform("y", lambda v: (v - F.col("mean_ic")) / F.col("n"))
    return a.select("horizon", "mean_ic", (F.col("mean_ic") / stats.se(z, F.col("lags"))).alias("t_stat"), F.col("n").cast("long").alias("n_dates"), (F.col("mean_ic") / F.col("horizon")).alias("ic_per_period"))


def horizon_half_life(table: DataFrame) -> DataFrame:
    """One row: half_life_periods (or null with a reason) and peak_horizon of an ``ic_by_horizon`` table."""
    a = table.agg(
        F.min("mean_ic").alias("low"), F.min_by("t_stat", "horizon").alias("t0"), F.count(F.lit(1)).alias("k"), F.min("horizon").alias("h0"),
        F.regr_slope(F.ln(F.when(F.col("mean_ic") > 0, F.col("mean_ic"))), F.col("horizon").cast("double")).alias("slope"),
        F.max(F.struct("mean_ic", (-F.col("horizon")).alias("neg"))).alias("top"),
    )
    reason = (
        F.when(F.col("low") <= 0, "the mean IC is not positive at every horizon")
        .when(~(F.coalesce("t0", F.lit(0.0)) >= 2), "the IC at the shortest horizon is not significant")
        .when(F.col("k") < 3, "fewer than three horizons have a positive mean IC")
        .when(~(F.coalesce("slope", F.lit(0.0)) < 0), "the mean IC does not fall with the horizon")
    )
    return a.select(F.when(reason.isNull(), F.col("h0") + F.lit(LN2) / -F.nullif("slope", F.lit(0.0))).alias("half_life_periods"), reason.alias("reason"), (-F.col("top.neg")).alias("peak_horizon"))
