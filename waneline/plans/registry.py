"""Named analytics queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waneline.functions import stats
from waneline.operators import align, breaks, compare, crowding, decay, panel, publication, report
from waneline.plans import fixtures as fx
from waneline.sources import factors as factor_files
from waneline.streaming import daily

SAMPLE_END, PUBLISHED = "1997-12-31", "1999-01-01"


def tidy(df: DataFrame, places: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, without negative zeros, so that engines that add in another order agree."""
    return df.select(*[(F.round(F.col(f.name), own.get(f.name, places)) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def _ic(method: str) -> Callable:
    return lambda s, d: tidy(panel.ic_series(fx.brand_signal(s, d), panel.forward_returns(fx.brand_returns(s, d)), method))


def _rolling_ic(s: SparkSession, d: str) -> DataFrame:
    return tidy(panel.rolling_ic(fx.brand_signal(s, d), panel.forward_returns(fx.brand_returns(s, d)), window=12, min_periods=10).select("date", "value"))


def _sharpe(freq: str, window: int, least: int | None, source: Callable) -> Callable:
    return lambda s, d: tidy(panel.rolling_sharpe(source(s, d), window, freq, 0.0, least))


def _sharpe_rf(s: SparkSession, d: str) -> DataFrame:
    r = fx.brand_returns(s, d).select(F.col("asset_id").alias("series_id"), "date", "value")
    rf = r.groupBy("date").agg((F.month("date").cast("double") / 1000).alias("value"))
    return tidy(panel.rolling_sharpe(r, 12, "M", rf, 6))


def _gappy(s: SparkSession, d: str) -> DataFrame:
    """Supplier series with every value of February missing."""
    return fx.supplier_month(s, d).withColumn("value", F.when(F.month("date") != 2, F.col("value")))


def _align(s: SparkSession, d: str) -> DataFrame:
    left = fx.brand_signal(s, d).filter(F.month("date") != 3)
    right = fx.brand_returns(s, d).filter(F.substring("asset_id", -1, 1) != "1")
    return align.align_panels(left, right).groupBy("date").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"))


def _excluded(s: SparkSession, d: str) -> DataFrame:
    left = fx.brand_signal(s, d).filter(F.month("date") != 3)
    right = fx.brand_returns(s, d).filter(F.substring("asset_id", -1, 1) != "1")
    return align.excluded(left, right).select("series_id", "kind", "count")


def _line(s: SparkSession, d: str) -> DataFrame:
    return tidy(breaks.hac_line(align.years_since_start(fx.supplier_month(s, d))))


def _break(f: Callable) -> Callable:
    return lambda s, d: tidy(f(fx.supplier_month(s, d)))


def _adjust(method: str) -> Callable:
    return lambda s, d: tidy(compare.adjust(breaks.chow_test(fx.supplier_month(s, d), PUBLISHED).select("series_id", "p_value"), method))


def _decay_point(s: SparkSession, d: str) -> DataFrame:
    fits = decay.fit_decay(fx.supplier_month(s, d), n_boot=0)
    keep = fits.select("series_id", "model", "decay_rate", "initial_level", "r2_exponential", "r2_linear", "aic_exponential", "aic_linear", "better_fit", "linear_slope", "n_obs", "start", "end", "block_size", "fallback")
    return tidy(keep, 4, initial_level=2)


def _grid(s: SparkSession, d: str) -> DataFrame:
    return tidy(decay.mesh_fit(fx.supplier_month(s, d)), 4, sse=1)


def _trend_draws(s: SparkSession, d: str) -> DataFrame:
    return tidy(decay.trend_draws(fx.supplier_month(s, d)), 5)


def _fits(s: SparkSession, d: str) -> DataFrame:
    return decay.fit_decay(fx.supplier_month(s, d))


def _lifetime(s: SparkSession, d: str) -> DataFrame:
    """Lifetimes of fits given by the linear trend, so that every case of the rule has rows."""
    line = breaks.hac_line(align.years_since_start(fx.supplier_month(s, d)))
    k = F.col("series_id").cast("int")
    fits = line.select(
        "series_id", F.when(k % 2 == 0, "exponential").otherwise("linear").alias("model"), (k % 5 != 0).alias("decay_detected"), F.when(k % 7 == 0, -F.col("intercept")).otherwise(F.col("intercept")).alias("initial_level"),
        (F.abs("slope") / 100 + 0.05).alias("decay_rate"), (F.lit(0.02) - F.when(k % 3 == 0, 0.03).otherwise(0.0)).alias("rate_lo"), (F.abs("slope") / 50 + 0.1).alias("rate_hi"), F.lit("1995-01-31").cast("date").alias("start"), F.lit("2001-07-31").cast("date").alias("end"),
    )
    return tidy(decay.signal_lifetime(fits, floor=150.0), 4)


def _walk(s: SparkSession, d: str) -> DataFrame:
    return compare.walk_forward(fx.supplier_month(s, d), min_obs=48, step=12)


def _horizons(s: SparkSession, d: str) -> DataFrame:
    return compare.ic_by_horizon(fx.brand_signal(s, d), fx.brand_returns(s, d), (1, 2, 3, 6))


def _crowding(method: str, n_factors: int) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        f = None if n_factors == 0 else fx.factors(s, d) if n_factors == 1 else fx.factors3(s, d)
        return tidy(crowding.crowding_score(fx.brand_week(s, d), fx.legs(s, d), f, window=52, method=method, min_obs=26))

    return run


def _link(s: SparkSession, d: str) -> DataFrame:
    score = crowding.crowding_score(fx.brand_week(s, d), fx.legs(s, d), None, window=52)
    return tidy(crowding.crowding_link(fx.strategy(s, d), score, 3))


def _report(s: SparkSession, d: str) -> report.FadeReport:
    return report.analyze(
        fx.strategy(s, d).select("date", "value"), fx.brand_signal(s, d), panel.forward_returns(fx.brand_returns(s, d)), SAMPLE_END, PUBLISHED,
        crowding.crowding_score(fx.brand_week(s, d), fx.legs(s, d), None, window=52), crowding_horizon=3, window=12, freq="M",
    )


def _json(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(_report(s, d).to_json(),)], "report string")


_CSV = "A preamble line.\r\n\r\n,Mkt-RF,SMB,HML,RF\r\n192607,    2.96,   -2.56,   -2.43,    0.22\r\n192608,    2.64,  -99.99,    3.82,    0.25\r\n192602,    0.10,    0.20, -999,    0.25\r\n,,,\r\n Annual,,,\r\n1927,1,2,3,4\r\n"


def _factor_csv(s: SparkSession, d: str) -> DataFrame:
    texts = s.createDataFrame([("file", _CSV)], "path string, text string")
    return tidy(factor_files.parse(texts, ("Mkt-RF", "SMB", "HML", "RF"), "M").select("date", "mkt_rf", "smb", "hml", "rf"))


def _p_values(s: SparkSession, d: str) -> DataFrame:
    x = s.range(0, 60).select((F.col("id") / F.lit(3.0)).alias("stat"))
    return tidy(x.select("stat", stats.chi2_sf(F.col("stat")).alias("chi2_p"), stats.kolmogorov_sf(F.col("stat") / 4).alias("kolmogorov_p"), stats.sup_wald_p(F.col("stat"), 0.15).alias("sup_wald_p")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ic_spearman": _ic("spearman"),
    "ic_pearson": _ic("pearson"),
    "forward_returns_1": lambda s, d: tidy(panel.forward_returns(fx.brand_returns(s, d), 1)),
    "forward_returns_3": lambda s, d: tidy(panel.forward_returns(fx.brand_returns(s, d), 3)),
    "rolling_ic": _rolling_ic,
    "rolling_sharpe_m": _sharpe("M", 24, None, fx.supplier_month),
    "rolling_sharpe_d": _sharpe("D", 252, 200, fx.day_series),
    "rolling_sharpe_rf": _sharpe_rf,
    "infer_freq": lambda s, d: tidy(align.infer_freq(fx.supplier_month(s, d).unionByName(fx.day_series(s, d)).unionByName(fx.event_day(s, d)))),
    "dropna_trim": lambda s, d: align.dropped(_gappy(s, d)).select("series_id", "kind", "count"),
    "align_panels": _align,
    "align_excluded": _excluded,
    "years_axis": lambda s, d: tidy(align.years_since_start(_gappy(s, d)).select("series_id", "date", "t")),
    "hac_mean": lambda s, d: tidy(breaks.hac_mean(fx.supplier_month(s, d))),
    "hac_ols_trend": _line,
    "chow_test": _break(lambda x: breaks.chow_test(x, PUBLISHED)),
    "sup_wald": _break(breaks.sup_wald),
    "sup_wald_path": _break(breaks.sup_wald_path),
    "cusum": _break(breaks.cusum),
    "cusum_path": _break(lambda x: breaks.cusum_path(x).drop("n")),
    "p_values": _p_values,
    "publication_gap": _break(lambda x: publication.publication_gap(x, SAMPLE_END, PUBLISHED)),
    "publication_table": _break(lambda x: publication.publication_table(x, SAMPLE_END, PUBLISHED, freq="M")),
    "lambda_grid_fit": _grid,
    "decay_point": _decay_point,
    "decay_boot_hash": _trend_draws,
    "fit_decay": _fits,
    "signal_lifetime": _lifetime,
    "holm": _adjust("holm"),
    "bh": _adjust("bh"),
    "compare_signals": lambda s, d: compare.compare_signals(fx.supplier_month(s, d)),
    "walk_forward": _walk,
    "walk_forward_stability": lambda s, d: compare.walk_forward_stability(_walk(s, d)),
    "ic_by_horizon": lambda s, d: tidy(_horizons(s, d)),
    "horizon_half_life": lambda s, d: tidy(compare.horizon_half_life(_horizons(s, d))),
    "crowding_loo": _crowding("leave_one_out", 0),
    "crowding_pairwise": _crowding("pairwise", 0),
    "crowding_1factor": _crowding("leave_one_out", 1),
    "crowding_kfactor": _crowding("leave_one_out", 3),
    "crowding_link": _link,
    "report_frame": lambda s, d: _report(s, d).to_frame(),
    "report_json": _json,
    "factor_csv": _factor_csv,
    "daily_values": lambda s, d: tidy(daily.daily_values(s.read.parquet(f"{d}/events.parquet")), 4),
}


def oracles() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    from waneline.plans import oracle

    return oracle.sql()
