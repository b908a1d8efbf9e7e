"""Every query against its SQL in another engine, at the smallest scale (which has gaps between dates)."""

import duckdb
import pandas as pd
import pytest

from waneline.plans import oracle, registry

ORACLES = oracle.sql()
TABLES = ("lineitem", "part", "events")
#: Queries whose rows the tests compare; the driver compares the others at a larger scale.
NAMES = ("ic_spearman", "ic_pearson", "forward_returns_3", "rolling_sharpe_m", "infer_freq", "hac_mean", "hac_ols_trend", "chow_test", "sup_wald", "cusum", "p_values", "factor_csv", "daily_values", "align_panels", "dropna_trim", "decay_point", "lambda_grid_fit", "decay_boot_hash", "crowding_kfactor", "crowding_1factor")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = [tuple(None if not isinstance(v, str) and pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v for v in r) for r in df.itertuples(index=False)]
    return sorted(plain, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours = rows(registry.QUERIES[name](spark, sf).toPandas())
    theirs = rows(con.sql(ORACLES[name]).df())
    assert len(ours) == len(theirs) and len(ours) > 0
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else [x if not isinstance(x, float) else pytest.approx(x, abs=2e-5) for x in a] == list(b)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.QUERIES)
