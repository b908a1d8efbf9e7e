"""Forward returns, information coefficients and rolling quality measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waneline.functions import model
from waneline.functions.errors import AlignmentError, FrequencyError, InputError, InsufficientDataError
from waneline.operators import align


def _no_loss_beyond_all(panel: DataFrame) -> None:
    model.need_unique_cells(panel)
    if panel.filter(F.col("value") < -1).limit(1).collect():
        raise InputError("returns has values below -1. Simple returns as decimals are needed; convert log returns or percents first.")


def forward_returns(panel: DataFrame, periods: int = 1, check: bool = True) -> DataFrame:
    """Row t holds the return compounded over the next ``periods`` dates, null if any of them is missing.

    Positions are those of the panel's dates. Each cell is sent to the dates before it at
    which it counts, and the product is taken by group, so there is no join of the panel
    with itself.
    """
    model.need_int("periods", periods, 1)
    if check:
        _no_loss_beyond_all(panel)
    cal = F.broadcast(align.calendar(panel))  # a row per period: bounded by the calendar
    cells = panel.join(cal, "date")
    if periods == 1:
        ahead = cells.filter("value is not null").select("asset_id", (F.col("i") - 1).alias("i"), F.col("value").alias("fwd"))
    else:
        sent = cells.filter("value is not null").select("asset_id", F.explode(F.sequence(F.col("i") - periods, F.col("i") - 1)).alias("i"), (1.0 + F.col("value")).alias("g"))
        ahead = sent.groupBy("asset_id", "i").agg(F.count(F.lit(1)).alias("k"), F.product("g").alias("p")).filter(F.col("k") == periods).select("asset_id", "i", (F.col("p") - 1.0).alias("fwd"))
    grid = cells.select("asset_id", "i").join(ahead.filter("i >= 0"), ["asset_id", "i"], "full")  # a cell missing at t can still have a future
    return grid.join(cal, "i").select("date", "asset_id", F.col("fwd").alias("value"))


def ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average ranks of ``value`` within the keys; ties share the mean of their places."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(out, first + (ties - 1) / F.lit(2.0))


def correlations(df: DataFrame, keys: list[str], x: str, y: str, least: int, floor: float = 0.0) -> DataFrame:
    """keys, n and corr by centred sums, clipped to [-1, 1]; null below ``least`` rows or without spread."""
    w = Window.partitionBy(*keys)
    dx, dy = F.col(x) - F.avg(x).over(w), F.col(y) - F.avg(y).over(w)
    sums = df.select(*keys, F.col(x).alias("_rx"), F.col(y).alias("_ry"), dx.alias("_x"), dy.alias("_y")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") * F.col("_y")).alias("_xy"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"),
        (F.max("_rx") - F.min("_rx")).alias("_sx"), F.max(F.abs("_rx")).alias("_mx"), (F.max("_ry") - F.min("_ry")).alias("_sy"), F.max(F.abs("_ry")).alias("_my"),
    )
    spread = (F.col("_sx") > floor * F.col("_mx")) & (F.col("_sy") > floor * F.col("_my")) & (F.col("_xx") * F.col("_yy") > 0)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_xy") / F.sqrt(F.nullif(F.col("_xx") * F.col("_yy"), F.lit(0.0)))))
    return sums.select(*keys, "n", F.when((F.col("n") >= least) & spread, r).alias("corr"))


def ic_series(signal: DataFrame, fwd: DataFrame, method: str = "spearman", min_assets: int = 5, keys: tuple[str, ...] = (), check: bool = True) -> DataFrame:
    """Correlation across assets of signal and forward return on each date that both panels have.

    Columns: keys, date, value, n. Ranks are taken over complete cells only. A date without a
    usable correlation stays as a row with a null value. ``keys`` are further columns of
    ``fwd`` (such as a horizon) for each of which the whole series is computed in the same plan.
    Panels without a common date or asset are an error (``check``).
    """
    model.need_choice("method", method, ("spearman", "pearson"))
    model.need_int("min_assets", min_assets, 2)
    by = [*keys, "date"]
    if check:
        align.need_overlap(signal, fwd)
    pairs = signal.filter("value is not null").withColumnRenamed("value", "s").join(fwd.filter("value is not null").withColumnRenamed("value", "f"), ["date", "asset_id"])
    x, y = "s", "f"
    if method == "spearman":
        pairs = ranks(ranks(pairs, by, "s", "_rs"), by, "f", "_rf")
        x, y = "_rs", "_rf"
    r = correlations(pairs, by, x, y, min_assets, 0.0 if method == "spearman" else 1e-12)
    spine = fwd.select(*by).distinct().join(signal.select("date").distinct(), "date", "left_semi")
    return spine.join(r, by, "left").select(*by, F.col("corr").alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ic_diagnostics(ic: DataFrame, min_assets: int = 5) -> DataFrame:
    """Diagnostics of ``ic_series``: dates with too few assets, and dates without spread."""
    kind = F.when((F.col("n") > 0) & (F.col("n") < min_assets), "too_few_assets").when((F.col("n") >= min_assets) & F.col("value").isNull(), "constant_cross_section")
    out = ic.withColumn("kind", kind).filter("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.lit("ic").alias("series_id"), "kind", "count", F.concat(F.lit("IC set to null on "), F.col("count").cast("string"), F.lit(" date(s)")).alias("message"))


def _frame(window: int) -> Window:
    return Window.partitionBy("series_id").orderBy("date").rowsBetween(-(window - 1), 0)


def rolling_mean(df: DataFrame, window: int, min_periods: int | None = None) -> DataFrame:
    """Mean of the last ``window`` rows of each series, null below ``min_periods`` values; carries its window."""
    model.need_int("window", window, 2)
    least = window if min_periods is None else model.need_int("min_periods", min_periods, 2, window)
    w = _frame(window)
    v = F.when(F.count("value").over(w) >= least, F.avg("value").over(w))
    return df.select("series_id", "date", v.alias("value", metadata={model.WINDOW_KEY: window}))


def rolling_ic(signal: DataFrame, fwd: DataFrame, window: int = 36, method: str = "spearman", min_assets: int = 5, min_periods: int | None = None, freq: str | None = None) -> DataFrame:
    """Rolling mean of the information coefficient, as a series named ``rolling_ic``.

    Fewer usable coefficients than ``min_periods`` are an error, and dates that are regular but
    not of the given ``freq``.
    """
    ic = ic_series(signal, fwd, method, min_assets).select(F.lit("rolling_ic").alias("series_id"), "date", "value")
    if freq is not None:
        found, want = align.infer_freq(ic).first(), model.parse_freq(freq)
        if found is not None and found["freq"] not in (None, want):
            raise FrequencyError(f"The dates look like {found['freq']}, not {want}.")
    out = rolling_mean(ic, window, min_periods)
    least = window if min_periods is None else min_periods
    if ic.filter("value is not null").limit(least).count() < least:
        raise InsufficientDataError(f"Fewer than {least} dates have an information coefficient.")
    return out


def rolling_sharpe(df: DataFrame, window: int = 252, freq: str | None = None, rf: float | DataFrame = 0.0, min_periods: int | None = None) -> DataFrame:
    """Annualised mean over deviation of returns in excess of ``rf`` (a number, or a table of date, value).

    Null until the window holds ``min_periods`` values, and where the window's spread is within
    1e-12 of its size, which is rounding, not risk.
    """
    model.need_int("window", window, 2)
    least = window if min_periods is None else model.need_int("min_periods", min_periods, 2, window)
    f = align.resolve_freq(df, freq)
    if isinstance(rf, DataFrame):
        if df.join(rf, "date", "left_anti").limit(1).collect():
            raise AlignmentError("rf does not cover every return date.")
        df = df.join(rf.select("date", F.col("value").alias("_rf")), "date", "left").withColumn("value", F.col("value") - F.col("_rf"))
    else:
        df = df.withColumn("value", F.col("value") - F.lit(model.need_number("rf", rf)))
    w = _frame(window)
    x = F.col("value")
    enough = F.count(x).over(w) >= least
    risky = (F.max(x).over(w) - F.min(x).over(w)) > F.lit(1e-12) * F.max(F.abs(x)).over(w)
    sharpe: Column = F.avg(x).over(w) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)) * F.lit(math.sqrt(model.PERIODS_PER_YEAR[f]))
    return df.select("series_id", "date", F.when(enough & risky, sharpe).alias("value", metadata={model.WINDOW_KEY: window}))
