"""Known answers, look-ahead and properties of forward returns, ICs and rolling measures."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from waneline.functions import model
from waneline.functions.errors import FrequencyError, InputError
from waneline.operators import align, panel

START = dt.date(2020, 1, 31)


def month(k: int) -> dt.date:
    y, m = divmod(k, 12)
    return (dt.date(2020 + y + (m + 1) // 12, (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)) if m < 11 else dt.date(2020 + y, 12, 31)


def make(spark, values, name="a"):
    return spark.createDataFrame([(month(i), name, None if v is None else float(v)) for i, v in enumerate(values)], "date date, asset_id string, value double")


def one(df, col="value"):
    return [r[col] for r in df.orderBy("date").collect()]


def test_forward_returns_compound(spark):
    assert one(panel.forward_returns(make(spark, [0.10, 0.20, -0.50, 0.0]), 2)) == pytest.approx([1.2 * 0.5 - 1, -0.5, None, None])


def test_total_loss_is_kept(spark):
    assert one(panel.forward_returns(make(spark, [0.1, -1.0, 0.5]), 2)) == [-1.0, None, None]


def test_missing_cell_blocks_and_never_shifts(spark):
    df = make(spark, [0.1, None, 0.3, 0.4]).unionByName(make(spark, [0.0] * 4, "b"))
    got = {(r["date"], r["asset_id"]): r["value"] for r in panel.forward_returns(df, 1).collect()}
    assert got[month(0), "a"] is None and got[month(1), "a"] == pytest.approx(0.3)


def test_future_counts_where_the_present_is_absent(spark):
    df = make(spark, [0.1, 0.2, 0.3]).filter("value <> 0.2").unionByName(make(spark, [0.0] * 3, "b"))
    got = {(r["date"], r["asset_id"]): r["value"] for r in panel.forward_returns(df, 1).collect()}
    assert got[month(1), "a"] == pytest.approx(0.3)


def test_below_minus_one_is_refused(spark):
    with pytest.raises(InputError):
        panel.forward_returns(make(spark, [0.1, -1.5]))


def test_ic_known_answers(spark):
    sig = [[1, 2, 3], [1, 2, 3], [1, 2, 3], [1, 1, 2]]
    fwd = [[1, 3, 2], [1, 2, 3], [3, 2, 1], [2, 1, 0]]
    wide = lambda x: spark.createDataFrame([(month(i), c, float(v)) for i, row in enumerate(x) for c, v in zip("abc", row, strict=True)], "date date, asset_id string, value double")
    assert one(panel.ic_series(wide(sig), wide(fwd), min_assets=3)) == pytest.approx([0.5, 1.0, -1.0, -math.sqrt(3) / 2])


def test_ic_rows_survive_without_data(spark):
    sig, fwd = make(spark, [1, 2]), make(spark, [None, 0.1])
    out = panel.ic_series(sig, fwd, min_assets=2).orderBy("date").collect()
    assert [r["value"] for r in out] == [None, None] and [r["n"] for r in out] == [0, 1]
    assert {r["kind"] for r in panel.ic_diagnostics(panel.ic_series(sig, fwd, min_assets=2), 2).collect()} == {"too_few_assets"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=5, max_size=8))
def test_ic_is_bounded_and_rank_invariant(spark, cells):
    build = lambda f: (spark.createDataFrame([(START, str(i), float(f(s))) for i, (s, _) in enumerate(cells)], "date date, asset_id string, value double"), spark.createDataFrame([(START, str(i), float(r)) for i, (_, r) in enumerate(cells)], "date date, asset_id string, value double"))
    a = panel.ic_series(*build(lambda x: x)).first()["value"]
    b = panel.ic_series(*build(lambda x: math.exp(x / 10))).first()["value"]
    assert a == b if a is None else -1 <= a <= 1 and a == pytest.approx(b)


def test_rolling_keeps_its_window_and_constant_windows_are_null(spark):
    df = make(spark, [0.01] * 5 + [0.02, 0.03]).selectExpr("asset_id as series_id", "date", "value")
    out = panel.rolling_sharpe(df, 3, "M")
    assert model.window_of(out) == 3
    v = one(out)
    assert v[:5] == [None] * 5
    assert v[6] == pytest.approx(np.mean([0.01, 0.02, 0.03]) / np.std([0.01, 0.02, 0.03], ddof=1) * math.sqrt(12))


def test_frequencies(spark):
    assert model.parse_freq("Monthly") == "M"
    with pytest.raises(FrequencyError):
        model.parse_freq("hourly")
    df = make(spark, range(6)).selectExpr("asset_id as series_id", "date", "value")
    assert align.resolve_freq(df, None) == "M"
    odd = spark.createDataFrame([("x", START + dt.timedelta(days=15 * i), 1.0) for i in range(6)], "series_id string, date date, value double")
    with pytest.raises(FrequencyError):
        align.resolve_freq(odd, None)


def test_bad_tables_are_refused(spark):
    with pytest.raises(InputError):
        model.series(spark.createDataFrame([(START, True)], "date date, value boolean"))
    twice = spark.createDataFrame([("x", START, 1.0), ("x", START, 2.0)], "series_id string, date date, value double")
    with pytest.raises(InputError):
        model.checked(twice)


def test_empty_panel(spark):
    empty = make(spark, [0.1]).filter("false")
    assert panel.forward_returns(empty).count() == 0 and panel.ic_series(empty, empty).count() == 0
