"""Inputs that operators must reject, each with the error it is meant to raise."""

import datetime as dt
import socket
import warnings
import zipfile

import pytest

from waneline.functions import model
from waneline.functions.errors import AlignmentError, DownloadError, FitWarning, FrequencyError, InputError, InsufficientDataError
from waneline.operators import align, breaks, compare, crowding, decay, panel, report
from waneline.sources import factors

PANEL = "date date, asset_id string, value double"


def day(k: int, step: int = 30) -> dt.date:
    return dt.date(2000, 1, 31) + dt.timedelta(days=step * k)


def cells(spark, n=4, assets="abcdef", first=0):
    return spark.createDataFrame([(day(first + k), a, 0.01 * ((k * 7 + ord(a) * 3) % 11 - 5)) for k in range(n) for a in assets], PANEL)


def series(spark, values, name="s", step=30):
    return spark.createDataFrame([(name, day(k, step), float(v)) for k, v in enumerate(values)], "series_id string, date date, value double")


def test_cells_that_come_twice(spark):
    p = cells(spark)
    twice = p.unionByName(p.limit(1))
    for f in (lambda: panel.forward_returns(twice), lambda: model.panel(twice)):
        with pytest.raises(InputError, match="keep one a cell"):
            f()
    with pytest.raises(InputError, match="infinite"):
        model.panel(spark.createDataFrame([(day(0), "a", float("inf"))], PANEL))
    assert model.panel(p).columns == ["date", "asset_id", "value"]


def test_explicit_lags(spark):
    df = series(spark, range(30))
    assert breaks.hac_mean(df, hac_lags=3).first()["lags"] == 3
    for bad in (-1, 1.5, True):
        with pytest.raises(InputError):
            breaks.hac_mean(df, hac_lags=bad)
    with pytest.raises(InputError, match="overlap"):
        breaks.hac_mean(panel.rolling_mean(df, 6), hac_lags=2)
    with pytest.raises(Exception, match="below the number of observations"):
        breaks.hac_mean(df, hac_lags=30).collect()


def test_panels_without_anything_in_common(spark):
    p = cells(spark)
    for other in (cells(spark, first=50), cells(spark, assets="uvwxyz")):
        for f in (lambda o=other: align.align_panels(p, o), lambda o=other: panel.ic_series(p, o)):
            with pytest.raises(AlignmentError):
                f()


def test_too_little_to_roll_or_to_compare(spark):
    p = cells(spark)
    with pytest.raises(InsufficientDataError):
        panel.rolling_ic(p, panel.forward_returns(p), window=12)
    with pytest.raises(FrequencyError):
        panel.rolling_ic(p, panel.forward_returns(p), window=2, freq="W")
    with pytest.raises(InsufficientDataError):
        compare.compare_signals(series(spark, range(40)), n_boot=100)


def test_factors_with_gaps_or_of_another_frequency(spark):
    p = cells(spark, 8)
    members = spark.createDataFrame([(day(7), "long", a) for a in "abcdef"], "formation_date date, leg string, asset_id string")
    whole = [(day(k), 0.01 * k) for k in range(8)]
    for bad in (whole[:-1], [(d, None if k == 3 else v) for k, (d, v) in enumerate(whole)]):
        with pytest.raises(AlignmentError):
            crowding.crowding_score(p, members, spark.createDataFrame(bad, "date date, mkt double"), window=5, min_obs=3)
    with pytest.raises(FrequencyError):
        daily = [(day(0) + dt.timedelta(days=k), 0.01) for k in range(240)]
        crowding.crowding_score(p, members, spark.createDataFrame(daily, "date date, mkt double"), window=5, min_obs=3)


def test_factors_that_repeat_each_other_count_once(spark):
    p = cells(spark, 30, "abcdefgh")
    members = spark.createDataFrame([(day(29), "long", a) for a in "abcdefgh"], "formation_date date, leg string, asset_id string")
    one = spark.createDataFrame([(day(k), ((k * 13) % 7) / 100) for k in range(30)], "date date, mkt double")
    both = one.selectExpr("date", "mkt", "mkt * 2 + 1 as again")
    a, b = (crowding.crowding_score(p, members, f, window=26, min_obs=20).first() for f in (one, both))
    assert a["long"] == pytest.approx(b["long"], abs=1e-9)


def test_point_fit_has_no_interval(spark):
    fit = decay.fit_decay(series(spark, [1 / (1 + k) for k in range(40)]), n_boot=0).first()
    assert fit["decay_rate"] > 0 and fit["rate_lo"] is None and fit["p_value"] is None and not fit["decay_detected"]
    with pytest.raises(InputError):
        decay.fit_decay(series(spark, range(40)), n_boot=50)


def test_a_fit_at_its_bound_warns(spark):
    df = series(spark, [0.0] * 25 + [0.5] * 3 + [5.0 * 3**k for k in range(8)]).drop("series_id")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = report.analyze(df, n_boot=100, freq="M")
    assert out.return_decay["fallback"] and any(isinstance(w.message, FitWarning) for w in seen)


def test_frequency_names():
    assert [model.parse_freq(x) for x in ("Daily", " b ", "ME", "yearly", "q")] == ["D", "D", "M", "A", "Q"]
    for bad in ("x", "", "d w", None):
        with pytest.raises(FrequencyError):
            model.parse_freq(bad)


def test_downloads_need_https_and_a_server():
    with pytest.raises(DownloadError, match="https"):
        factors.download("http://localhost/x.zip")
    with socket.socket() as s:  # a closed port
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    with pytest.raises(DownloadError, match="could not be fetched"):
        factors.download(f"https://127.0.0.1:{port}/x.zip")


def test_factor_files_of_other_kinds(spark, tmp_path):
    good = ",Mkt-RF,SMB,HML,RF\r\n192607, 2.96, -2.56, -2.43, 0.22\r\n\r\n"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("notes.txt", "x")
        z.writestr("f.CSV", ("Übersicht\r\n" + good).encode("latin-1"))
    assert factors.load_ff3(spark, path=str(tmp_path / "f.zip")).first()["smb"] == pytest.approx(-0.0256)
    (tmp_path / "bad.csv").write_text(good.replace("-2.56", "n/a"))
    with pytest.raises(InputError, match="SMB"):
        factors.load_ff3(spark, path=str(tmp_path / "bad.csv"))
    (tmp_path / "twice.csv").write_text(good.replace("\r\n\r\n", "\r\n192607, 1, 1, 1, 1\r\n\r\n"))
    with pytest.raises(InputError, match="duplicate"):
        factors.load_ff3(spark, path=str(tmp_path / "twice.csv"))
    with pytest.raises(InputError, match="digits"):
        factors.load_ff3(spark, "D", path=str(tmp_path / "f.zip"))


def test_results_in_words(spark):
    fits = decay.fit_decay(series(spark, [2.0 ** (-k / 12) + 0.001 * (k % 3) for k in range(60)]), n_boot=100)
    fit = fits.first().asDict()
    assert "halves in" in report.say_decay(fit)
    life = decay.signal_lifetime(fits, fraction=0.5).first().asDict()
    assert "years from the start" in report.say_lifetime(life)
    never = decay.signal_lifetime(fits, floor=-1.0).first().asDict()
    assert "No date" in report.say_lifetime(never)
    assert "1 of 2 signals fade" in report.say_comparison([{"series_id": "a", "decay_detected_adjusted": True}, {"series_id": "b", "decay_detected_adjusted": False}])
    assert "in 50% of the windows" in report.say_stability({"series_id": "a", "share_detected": 0.5, "stable_since": None})
    assert "peaks at horizon 2" in report.say_horizon({"peak_horizon": 2, "half_life_periods": None, "reason": "none"})
    shift = breaks.significant(breaks.sup_wald(series(spark, [1 + 0.01 * (k % 3) for k in range(30)] + [3 + 0.01 * (k % 3) for k in range(30)]))).first()
    assert shift["n_obs"] == 60 and shift["significant"] and "rose" in report.say_break(shift.asDict())
