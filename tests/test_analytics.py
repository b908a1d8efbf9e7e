"""Breaks, decay, lifetime, comparison, crowding, report and sources: known answers and planted truths."""

import datetime as dt
import json
import math
import zipfile

import numpy as np
import pytest

from waneline.functions import stats
from waneline.functions.errors import InputError
from waneline.operators import breaks, compare, crowding, decay, publication, report
from waneline.sources import factors


def months(n: int, start: int = 1980) -> list[dt.date]:
    return [dt.date(start + (m + 1) // 12, (m + 1) % 12 + 1, 1) - dt.timedelta(days=1) for m in range(n)]


def table(spark, **named):
    rows = [(k, d, float(v)) for k, x in named.items() for d, v in zip(months(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def newey_west(y, x, lags):
    y, x = np.asarray(y, float), np.asarray(x, float)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    s = x * (y - x @ beta)[:, None]
    omega = s.T @ s
    for k in range(1, lags + 1):
        g = s[k:].T @ s[:-k]
        omega += (1 - k / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(inv @ omega @ inv))


def test_robust_means_and_trends_match_matrix_algebra(spark):
    y = np.random.default_rng(1).normal(0.3, 1, 90)
    df = table(spark, a=y)
    m = breaks.hac_mean(df).first()
    b, se = newey_west(y, np.ones((90, 1)), 3)
    assert (m["mean"], m["se"], m["lags"]) == pytest.approx((b[0], se[0], 3), rel=1e-10)
    from waneline.operators.align import years_since_start

    line = breaks.hac_line(years_since_start(df)).first()
    t = np.array([(d - months(1)[0]).days / 365.25 for d in months(90)])
    b, se = newey_west(y, np.column_stack([np.ones(90), t]), 3)
    assert (line["intercept"], line["slope"], line["t_intercept"], line["t_slope"]) == pytest.approx((*b, *(b / se)), rel=1e-8)


def test_breaks_find_a_planted_shift(spark):
    rng = np.random.default_rng(2)
    y = np.r_[rng.normal(1, 0.3, 120), rng.normal(0, 0.3, 120)]
    df = table(spark, shift=y, noise=rng.normal(0, 1, 240), short=[1, 2, 3], flat=[1] * 40)
    for f in (breaks.sup_wald, breaks.cusum):
        got = {r["series_id"]: r for r in f(df).collect()}
        assert set(got) == {"shift", "noise"}
        assert abs(got["shift"]["n_before"] - 120) <= 3 and got["shift"]["p_value"] < 0.01 and got["noise"]["p_value"] > 0.01
    chow = {r["series_id"]: r for r in breaks.chow_test(df, months(121)[-1]).collect()}["shift"]
    x = np.column_stack([np.ones(240), np.r_[np.zeros(120), np.ones(120)]])
    b, se = newey_west(y, x, chow["hac_lags"])
    assert chow["change_t"] == pytest.approx(b[1] / se[1], rel=1e-8)
    assert {r["series_id"]: r["kind"] for r in breaks.unusable(df).collect()} == {"short": "too_short", "flat": "constant"}
    with pytest.raises(InputError):
        breaks.find_break(df, trim=0.3)


def test_null_distribution_has_the_published_critical_values():
    at = lambda steps: [dict(zip(stats.SUP_WALD_LEVELS, stats.sup_wald_quantiles(0.15, steps), strict=True))[x] for x in (0.9, 0.95, 0.99)]
    assert at(5000) == pytest.approx([7.20, 8.76, 12.28], abs=0.02)
    assert at(None) == pytest.approx([7.30, 8.86, 12.40], abs=0.01)


@pytest.mark.parametrize("trim", stats.SUP_WALD_TRIMS)
def test_null_distribution_matches_a_simulation(trim):
    """Walks of 500 steps, drawn here: the computed levels lie within the simulation's error."""
    steps, reps = 500, 40_000
    rng, p = np.random.default_rng(17), np.arange(1, steps + 1) / steps
    inside = (p >= trim - 1e-12) & (p <= 1 - trim + 1e-12)
    top = []
    for _ in range(reps // 4000):
        walk = rng.standard_normal((4000, steps)).cumsum(1) / math.sqrt(steps)
        bridge = (walk - p * walk[:, -1:])[:, inside]
        top.append((bridge**2 / (p * (1 - p))[inside]).max(1))
    q = dict(zip(stats.SUP_WALD_LEVELS, stats.sup_wald_quantiles(trim, steps), strict=True))
    for level in (0.25, 0.5, 0.9, 0.95):
        share = (np.concatenate(top) <= q[level]).mean()
        assert abs(share - level) < 5 * math.sqrt(level * (1 - level) / reps) + 0.004


def test_decay_search_finds_the_least_error_of_a_fine_scan():
    rng, t = np.random.default_rng(12), np.cumsum(rng_steps := np.random.default_rng(13).integers(20, 40, 200)) / 365.25
    t = t - t[0]
    y = np.stack([np.exp(-t / k) + rng.normal(0, 0.3, len(t)) for k in np.linspace(0.3, 30, 60)] + [rng.normal(0, 1, len(t)) for _ in range(20)])
    f = decay.Profile(t)
    assert len(rng_steps) == len(t) and len(f.rates) == 221 and (np.diff(f.rates) > 0).all() and f.rates[60] == 0
    assert f.rates[-1] == pytest.approx(math.log(2) / max(t[-1] / 100, 3 * np.median(np.diff(t)))) and f.rates[0] == pytest.approx(-math.log(100) / t[-1]) and f.rates[61] == pytest.approx(f.rates[-1] * 1e-5)
    rate, level, sse = f.fit(y)
    e = np.exp(-np.outer(f.rates, t))
    on_mesh = (y * y).sum(1)[:, None] - (y @ e.T) ** 2 / (e * e).sum(1)
    assert (sse <= on_mesh.min(1) + 1e-9).all()
    for v, r, a, s in zip(y, rate, level, sse, strict=True):
        assert s == pytest.approx(((v - a * np.exp(-r * t)) ** 2).sum())
        if f.rates[0] < r < f.rates[-1]:
            near = np.exp(-np.outer(r + np.linspace(-1e-3, 1e-3, 41), t))
            assert s <= ((v * v).sum() - (near @ v) ** 2 / (near * near).sum(1)).min() + 1e-9


def test_block_draws_are_blocks_spread_evenly():
    d = decay.block_draws(103, 8, np.arange(4000), decay.stream("s", 0))
    assert d.shape == (4000, 103) and d.min() == 0 and d.max() == 102
    assert (np.diff(d.reshape(4000, -1)[:, :96].reshape(4000, 12, 8), axis=2) == 1).all()
    seen = np.bincount(d[:, ::8].ravel(), minlength=96)[:96]
    assert ((seen - seen.mean()) ** 2 / seen.mean()).sum() < 150  # chi-squared with 95 degrees
    assert (decay.block_draws(103, 8, np.arange(10, 20), 5) == decay.block_draws(103, 8, np.arange(4000), 5)[10:20]).all()
    assert [decay.block_length(n) for n in (1, 20, 79, 240, 1000)] == [1, 5, 8, 11, 18] and decay.block_length(100, 30) == 30 and decay.block_length(10, 30) == 10


def test_tail_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(w,) for w in (0.0, 0.5, 3.84, 20.0, 40.0)], "w double").select("w", stats.chi2_sf(F.col("w")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["w"] / 2)), abs=1e-7)


def test_decay_recovers_a_planted_half_life(spark):
    t = np.arange(480) / 12
    rng = np.random.default_rng(3)
    df = table(spark, fast=0.1 * np.exp(-t / 5) + rng.normal(0, 0.01, 480), noise=rng.normal(0, 0.02, 480), negative=-0.1 * np.exp(-t / 5) + rng.normal(0, 0.01, 480))
    got = {r["series_id"]: r for r in decay.fit_decay(df, n_boot=200).collect()}
    assert got["fast"]["decay_detected"] and got["fast"]["half_life_years"] == pytest.approx(5 * math.log(2), rel=0.15)
    assert got["fast"]["ci_low"] < 5 * math.log(2) < got["fast"]["ci_high"]
    assert got["negative"]["decay_detected"] and not got["noise"]["decay_detected"]
    alone = decay.fit_decay(df.filter("series_id = 'fast'"), n_boot=200).first()
    assert alone["rate_lo"] == got["fast"]["rate_lo"]  # random numbers follow the name, not the company
    life = {r["series_id"]: r for r in decay.signal_lifetime(decay.fit_decay(df, n_boot=200), fraction=0.5).collect()}
    assert life["fast"]["years_from_start"] == pytest.approx(got["fast"]["half_life_years"]) and life["noise"]["reason"] is not None
    with pytest.raises(InputError):
        decay.signal_lifetime(df, floor=1.0, fraction=0.5)


def test_walk_forward_never_looks_ahead(spark):
    rng = np.random.default_rng(4)
    y = 0.1 * np.exp(-np.arange(120) / 60) + rng.normal(0, 0.02, 120)
    changed = y.copy()
    changed[100:] += 5
    a = {r["n_obs"]: r for r in compare.walk_forward(table(spark, s=y), 60, 20, 100).collect()}
    b = {r["n_obs"]: r for r in compare.walk_forward(table(spark, s=changed), 60, 20, 100).collect()}
    assert sorted(a) == [60, 80, 100, 120] and all(a[k] == b[k] for k in (60, 80, 100)) and a[120] != b[120]


def test_corrections(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "series_id string, p_value double")
    get = lambda m: {r["series_id"]: round(r["p_adjusted"], 6) for r in compare.adjust(df, m).collect()}
    assert get("holm") == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02}
    assert get("bh") == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02}


def test_publication_gap(spark):
    y = [0.010] * 60 + [0.0074] * 24 + [0.0042] * 60
    y = np.array(y) + np.random.default_rng(5).normal(0, 1e-4, 144)
    df = table(spark, s=y)
    d = months(144)
    g = publication.publication_gap(df, d[59], d[84]).first()
    assert g["post_sample_decline"] == pytest.approx(0.26, abs=0.01) and g["post_publication_decline"] == pytest.approx(0.58, abs=0.01)
    x = np.column_stack([np.ones(144), np.repeat([0, 1, 0], [60, 24, 60]), np.repeat([0, 0, 1], [60, 24, 60])])
    b, se = newey_west(y, x, g["hac_lags"])
    assert g["post_publication_t"] == pytest.approx(b[2] / se[2], rel=1e-6)
    t = {r["period"]: r["n_obs"] for r in publication.publication_table(df, d[59], d[84]).collect()}
    assert t == {"in_sample": 60, "post_sample": 24, "post_publication": 60}
    with pytest.raises(InputError):
        publication.publication_gap(df, d[84], d[59])


def test_crowding_rises_with_a_common_loading(spark):
    rng = np.random.default_rng(6)
    dates = [dt.date(2000, 1, 7) + dt.timedelta(days=7 * i) for i in range(156)]
    common, rows = rng.normal(0, 0.02, 156), []
    for k in range(12):
        r = rng.normal(0, 0.02, 156) + common * (np.arange(156) > 78)
        rows += [(d, f"s{k:02d}", float(v)) for d, v in zip(dates, r, strict=True)]
    returns = spark.createDataFrame(rows, "date date, asset_id string, value double")
    forms = [dates[10], dates[70], dates[150], dates[155] + dt.timedelta(days=60)]
    members = spark.createDataFrame([(f, "long" if k < 6 else "short", f"s{k:02d}") for f in forms for k in range(12)], "formation_date date, leg string, asset_id string")
    for method in ("leave_one_out", "pairwise"):
        got = {r["date"]: r for r in crowding.crowding_score(returns, members, window=52, method=method).collect()}
        assert got[forms[0]]["long"] is None and got[forms[3]]["long"] is None and got[forms[3]]["n_long"] == 0
        assert got[forms[2]]["mean"] > got[forms[1]]["mean"] + 0.2 and got[forms[2]]["n_long"] == 6


def test_report(spark):
    rng = np.random.default_rng(7)
    df = table(spark, s=rng.normal(0.01, 0.02, 144)).drop("series_id")
    out = report.analyze(df, sample_end=months(60)[-1], publication_date=months(90)[-1], n_boot=100)
    tree = json.loads(out.to_json(include_series=True))
    assert tree["freq"] == "M" and tree["n_obs"] == 144 and tree["publication"]["hac_lags"] >= 1 and len(tree["series"]["returns"]) == 144
    assert {r["section"] for r in out.to_frame().collect()} == {"return_decay", "break_test", "publication"}
    assert out.verdict() in out.summary() and out.plot_data().filter("panel = 'growth'").count() == 144


TEXT = "preamble\r\n\r\n,Mom\r\n192701,  0.36\r\n192702, -99.99\r\n\r\nAnnual\r\n1927, 1\r\n"


def test_factor_files(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(TEXT.encode())
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("m.csv", TEXT)
    for name in ("m.csv", "m.zip"):
        got = factors.load_momentum(spark, path=str(tmp_path / name)).collect()
        assert [(str(r["date"]), r["umd"]) for r in got] == [("1927-01-31", 0.0036), ("1927-02-28", None)]
    with pytest.raises(InputError):
        factors.load_momentum(spark, "D", path=str(tmp_path / "m.csv"))
    with pytest.raises(InputError):
        factors.load_momentum(spark, "W")


def test_stream_writes_closed_days(spark, sf, tmp_path):
    from waneline.streaming import daily

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    daily.keep_series(daily.daily_values(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    whole = daily.daily_values(spark.read.parquet(f"{sf}/events.parquet")).count()
    assert 0 < daily.read_series(spark, str(tmp_path / "out")).count() <= whole
