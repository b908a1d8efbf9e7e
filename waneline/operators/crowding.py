"""Crowding: co-movement of factor-model residuals among the stocks of each leg of a trade.

Everything is keyed by formation date and leg. A formation date's window is the positions of
its last ``window`` return dates, so returns meet memberships in an equi-join on those positions.
Residuals come from window sums, for any number of factors: returns and the factors left are
freed of one factor after the other, which is least squares on all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waneline.functions import model, stats
from waneline.functions.errors import AlignmentError, FrequencyError, InputError
from waneline.operators import align, breaks, panel

LEG = ["formation_date", "leg"]
#: Share of a factor's sum of squares below which it counts as a combination of others.
DEPENDENT = 1e-12


def membership(df: DataFrame) -> DataFrame:
    """formation_date, leg, asset_id of a table that may also have a ``member`` flag; a null flag means no."""
    if "member" in df.columns:
        if df.filter("member is not null").select(F.col("member").cast("double").alias("m")).filter("m not in (0, 1)").limit(1).collect():
            raise InputError("member must hold true/false (or 1/0) only.")
        df = df.filter(F.coalesce(F.col("member").cast("boolean"), F.lit(False)))
    return df.select(F.col("formation_date").cast("date").alias("formation_date"), "leg", "asset_id").filter("formation_date is not null and asset_id is not null").distinct()


def _windows(returns: DataFrame, dates: DataFrame, window: int) -> DataFrame:
    """formation_date, date and position of each return date in its window; formation dates without a full or fresh window are absent."""
    cal = align.calendar(returns)
    # as-of: the last return date on or before each formation date, by one sorted pass over both
    both = cal.select("date", "i", F.lit(None).cast("date").alias("f")).unionByName(dates.select(F.col("formation_date").alias("date"), F.lit(None).cast("int").alias("i"), F.col("formation_date").alias("f")))
    asof = both.withColumn("end", F.last("i", ignorenulls=True).over(Window.orderBy("date", F.col("f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))).filter("f is not null")
    gap = F.datediff("date", F.lag("date").over(Window.orderBy("date")))
    edge = cal.withColumn("g", gap).agg(F.max("date").alias("last"), F.coalesce(F.median("g"), F.lit(7.0)).alias("g"))
    fresh = asof.join(F.broadcast(edge), F.datediff("f", "last") <= F.greatest(F.lit(2.0) * F.col("g"), F.lit(7.0)))  # one row
    spans = fresh.filter(F.col("end") >= window - 1).select(F.col("f").alias("formation_date"), F.explode(F.sequence(F.col("end") - (window - 1), F.col("end"))).alias("i"))
    return spans.join(cal, "i")


def _cells(returns: DataFrame, members: DataFrame, window: int, min_obs: int) -> DataFrame:
    """formation_date, leg, asset_id, date, r for members with ``min_obs`` returns in the window."""
    spans = _windows(returns, members.select("formation_date").distinct(), window)
    cells = spans.join(members, "formation_date").join(returns.filter("value is not null").select("asset_id", "date", F.col("value").alias("r")), ["asset_id", "date"])
    return cells.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*LEG, "asset_id"))).filter(F.col("_k") >= min_obs).drop("_k", "i")


def _residuals(cells: DataFrame, factors: DataFrame | None, names: list[str]) -> DataFrame:
    """Adds ``e``: residual of each member's return on a constant and the factors, over its own rows.

    A factor that the ones before it explain all but DEPENDENT of takes no part.
    """
    w = Window.partitionBy(*LEG, "asset_id")
    freed = lambda c: F.col(c) - F.avg(c).over(w)
    if not names:
        return cells.withColumn("e", freed("r"))
    xs = [f"_x{k}" for k in range(len(names))]
    cells = cells.join(factors.select("date", *[F.col(c).alias(x) for c, x in zip(names, xs, strict=True)]), "date")
    cells = cells.withColumns({"e": freed("r"), **{x: freed(x) for x in xs}})
    cells = cells.withColumns({f"{x}s": F.sum(F.col(x) * F.col(x)).over(w) for x in xs})  # sums of squares to begin with
    for k, x in enumerate(xs):
        own = F.sum(F.col(x) * F.col(x)).over(w)
        share = lambda c, x=x, own=own: F.when(own > DEPENDENT * F.col(f"{x}s"), F.sum(F.col(x) * F.col(c)).over(w) / own).otherwise(0.0)
        cells = cells.withColumns({c: F.col(c) - share(c) * F.col(x) for c in ["e", *xs[k + 1 :]]})
    return cells.drop(*xs, *(f"{x}s" for x in xs))


def _pair_correlations(e: DataFrame) -> DataFrame:
    """Mean correlation of all pairs of a leg over rows where both have a residual (three at least).

    Members of one leg at one date meet in an array; pairs are unrolled from it. Their number is
    fixed by the leg's size, which is what this measure asks for.
    """
    rows = e.groupBy(*LEG, "date").agg(F.array_sort(F.collect_list(F.struct("asset_id", "e"))).alias("m"))
    rows = rows.select(*LEG, "date", F.posexplode("m").alias("k", "a"), "m").select(*LEG, F.col("a.asset_id").alias("x"), F.col("a.e").alias("ex"), F.explode(F.slice("m", F.col("k") + 2, F.size("m"))).alias("b"))
    pairs = rows.select(*LEG, "x", F.col("b.asset_id").alias("y"), "ex", F.col("b.e").alias("ey"))
    return panel.correlations(pairs, [*LEG, "x", "y"], "ex", "ey", 3, 0.0)


def _leave_one_out(e: DataFrame) -> DataFrame:
    """Correlation of each stock with the mean of the other stocks of its leg, by total less own."""
    w = Window.partitionBy(*LEG, "date")
    others = e.withColumns({"_s": F.sum("e").over(w), "_c": F.count(F.lit(1)).over(w)}).filter("_c > 1").withColumn("o", (F.col("_s") - F.col("e")) / (F.col("_c") - 1))
    return panel.correlations(others, [*LEG, "asset_id"], "e", "o", 3, 0.0)


def crowding_score(returns: DataFrame, members: DataFrame, factors: DataFrame | None = None, window: int = 52, method: str = "leave_one_out", min_obs: int = 26, min_stocks: int = 5) -> DataFrame:
    """date, long, short, mean, n_long, n_short for every formation date.

    ``returns`` is a panel, ``members`` has formation_date, leg (long or short) and asset_id,
    ``factors`` has date and factor columns; one named rf, in any case, is subtracted from
    returns and is no factor. Scores are null before the window fills, well past the last
    return, and where fewer than ``min_stocks`` members qualify.
    """
    model.need_choice("method", method, ("leave_one_out", "pairwise"))
    model.need_int("window", window, 2)
    model.need_int("min_obs", min_obs, 3, window)
    model.need_int("min_stocks", min_stocks, 3)
    members = membership(members)
    names: list[str] = []
    if factors is not None:
        values = [c for c in factors.columns if c != "date"]
        gaps = returns.select("date").distinct().join(factors.withColumn("_there", F.lit(True)), "date", "left").filter(" or ".join(f"`{c}` is null" for c in ["_there", *values]))
        if gaps.limit(1).collect():
            raise AlignmentError("factors must cover every return date, without missing values.")
        freqs = {r["series_id"]: r["freq"] for name, df in (("returns", returns), ("factors", factors)) for r in align.infer_freq(df.select(F.lit(name).alias("series_id"), F.col("date").cast("date").alias("date"))).collect()}
        if None not in freqs.values() and len(set(freqs.values())) > 1:
            raise FrequencyError(f"returns are {freqs['returns']} and factors {freqs['factors']}; resample one of them.")
        rf = [c for c in factors.columns if c.lower() == "rf"]
        names = [c for c in factors.columns if c != "date" and c not in rf]
        factors = factors.select(F.col("date").cast("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in [*names, *rf]])
        if rf:
            returns = returns.join(factors.select("date", F.col(rf[0]).alias("_rf")), "date").withColumn("value", F.col("value") - F.col("_rf")).drop("_rf")
            factors = factors.drop(*rf)
    cells = _cells(returns, members, window, min_obs)
    sizes = cells.groupBy(*LEG).agg(F.count_distinct("asset_id").alias("n"))
    thick = cells.join(sizes.filter(F.col("n") >= min_stocks).select(*LEG), LEG, "left_semi")
    e = _residuals(thick, factors, names)
    r = _leave_one_out(e) if method == "leave_one_out" else _pair_correlations(e)
    scores = sizes.join(r.groupBy(*LEG).agg(F.avg("corr").alias("score")), LEG, "left")
    leg = lambda name, c: F.max(F.when(F.col("leg") == name, F.col(c)))
    wide = scores.groupBy("formation_date").agg(leg("long", "score").alias("long"), leg("short", "score").alias("short"), leg("long", "n").alias("n_long"), leg("short", "n").alias("n_short"))
    out = members.select("formation_date").distinct().join(wide, "formation_date", "left")
    both = F.array_compact(F.array("long", "short"))
    return out.select(F.col("formation_date").alias("date"), "long", "short", breaks.mean(both).alias("mean"), F.coalesce("n_long", F.lit(0)).cast("long").alias("n_long"), F.coalesce("n_short", F.lit(0)).cast("long").alias("n_short"))


def crowding_diagnostics(returns: DataFrame, members: DataFrame, window: int = 52, min_obs: int = 26) -> DataFrame:
    """Diagnostics: members without any return, and stock-windows with too few returns."""
    members = membership(members)
    unknown = members.select("asset_id").distinct().join(returns.select("asset_id").distinct(), "asset_id", "left_anti").agg(F.count(F.lit(1)).alias("count"))
    spans = _windows(returns, members.select("formation_date").distinct(), window)
    k = spans.join(members, "formation_date").join(returns.filter("value is not null").select("asset_id", "date", F.lit(1).alias("one")), ["asset_id", "date"], "left").groupBy(*LEG, "asset_id").agg(F.count("one").alias("k"))
    thin = k.filter(F.col("k") < min_obs).agg(F.count(F.lit(1)).alias("count"))
    row = lambda d, kind, text: d.select(F.lit("crowding").alias("series_id"), F.lit(kind).alias("kind"), "count", F.lit(text).alias("message"))
    return row(unknown, "unknown_members", "member stocks without returns").unionByName(row(thin, "thin_stock_windows", "stock-windows with too few returns"))


def crowding_link(returns: DataFrame, crowding: DataFrame, horizon: int, min_rows: int = 24) -> DataFrame:
    """One row: horizon, slope_per_sd, t_stat, correlation, n_obs of the future return on the crowding score in deviations.

    ``returns`` is one series, ``crowding`` a table with date and mean (or value). Standard errors
    cover the overlap of future windows. Empty where fewer than ``min_rows`` dates have both.
    """
    model.need_int("crowding_horizon", horizon, 1)
    score = "mean" if "mean" in crowding.columns else "value"
    future = panel.forward_returns(returns.select("date", F.col("series_id").alias("asset_id"), "value"), horizon)
    joined = crowding.select("date", F.col(score).alias("c")).join(future.select("date", F.col("value").alias("y")), "date").filter("c is not null and y is not null")
    a = joined.agg(F.array_sort(F.collect_list(F.struct("date", "c", "y"))).alias("_r")).select(F.size("_r").alias("n"), F.col("_r.c").alias("c"), F.col("_r.y").alias("y")).filter(F.col("n") >= min_rows)
    a = a.withColumns({"mc": breaks.mean(F.col("c")), "my": breaks.mean(F.col("y")), "lags": stats.lags(F.col("n"), None, horizon - 1)})
    a = a.withColumns({"sxx": breaks.total(F.transform("c", lambda v: (v - F.col("mc")) * (v - F.col("mc")))), "syy": breaks.total(F.transform("y", lambda v: (v - F.col("my")) * (v - F.col("my")))), "sxy": breaks.total(F.zip_with("c", "y", lambda u, v: (u - F.col("mc")) * (v - F.col("my"))))})
    a = a.filter("sxx > 0").withColumn("b", F.col("sxy") / F.col("sxx"))
    z = F.zip_with("c", "y", lambda u, v: (u - F.col("mc")) / F.col("sxx") * (v - F.col("my") - F.col("b") * (u - F.col("mc"))))
    sd = F.sqrt(F.col("sxx") / (F.col("n") - 1))
    return a.select(F.lit(horizon).alias("horizon"), (F.col("b") * sd).alias("slope_per_sd"), (F.col("b") / stats.se(z, F.col("lags"))).alias("t_stat"), (F.col("sxy") / F.sqrt(F.nullif(F.col("sxx") * F.col("syy"), F.lit(0.0)))).alias("correlation"), F.col("n").cast("long").alias("n_obs"))
