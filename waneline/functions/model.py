"""Tables of the engine, frequencies, and argument checks.

A series table has ``series_id, date, value`` (unique by series and date); a panel has
``date, asset_id, value``. Missing values are null rows or absent rows. A rolling result carries
its window in the metadata of ``value`` (key ``window``), which later operators read.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waneline.functions.errors import FrequencyError, InputError

WINDOW_KEY = "window"
DAYS_PER_YEAR = 365.25

#: Observations per year of each frequency.
PERIODS_PER_YEAR = {"D": 252, "W": 52, "M": 12, "Q": 4, "A": 1}

#: Spellings of each frequency, in any case.
FREQ_SPELLINGS = {
    "D": ("d", "b", "daily"),
    "W": ("w", "weekly"),
    "M": ("m", "me", "ms", "monthly"),
    "Q": ("q", "qe", "quarterly"),
    "A": ("a", "y", "ye", "annual", "yearly"),
}

#: Median gaps in days that make a frequency.
FREQ_BANDS = {"D": (1.0, 5.0), "W": (5.5, 10.0), "M": (25.0, 35.0), "Q": (80.0, 100.0), "A": (350.0, 380.0)}
#: Share of the time span that gaps outside the band may take.
MAX_OFF_BAND = 0.05
LARGEST = 1e100


def need_int(name: str, value: object, least: int, most: int | None = None) -> int:
    """The value as an int within bounds, or an InputError."""
    if isinstance(value, bool) or not isinstance(value, int) or value < least or (most is not None and value > most):
        raise InputError(f"{name} must be an integer of at least {least}{'' if most is None else f' and at most {most}'}, got {value!r}.")
    return value


def need_share(name: str, value: float, most: float = 1.0) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < most:
        raise InputError(f"{name} must be between 0 and {most:g}, got {value!r}.")
    return float(value)


def need_number(name: str, value: object) -> float:
    """A finite number that is not a boolean."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise InputError(f"{name} must be a finite number, got {value!r}.")
    return float(value)


def need_choice(name: str, value: str, choices: Sequence[str]) -> str:
    if value not in choices:
        raise InputError(f"{name} must be one of {', '.join(choices)}, got {value!r}.")
    return value


def need_date(name: str, value: str | dt.date) -> dt.date:
    """A date from ISO text, a date or a datetime without a zone."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            raise InputError(f"{name} has a time zone; drop it first.")
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value)[:10])
    except ValueError:
        raise InputError(f"{name} must be a date such as 2001-12-31, got {value!r}.") from None


def parse_freq(freq: str) -> str:
    """D, W, M, Q or A of any usual spelling."""
    spelled = str(freq).casefold().split()
    for letter, spellings in FREQ_SPELLINGS.items():
        if len(spelled) == 1 and spelled[0] in spellings:
            return letter
    raise FrequencyError(f"{freq!r} is no frequency; write one of {', '.join(FREQ_SPELLINGS)}.")


def series(df: DataFrame, series_id: str | Column | None = None, date: str = "date", value: str = "value") -> DataFrame:
    """The table as ``series_id, date, value`` with a double value; NaN becomes null.

    Rejects column types that cannot hold a series. The window metadata of the value column stays.
    """
    kind = df.schema[value].dataType
    if not isinstance(kind, T.NumericType):
        raise InputError(f"{value} must be numeric, got {kind.simpleString()}.")
    if not isinstance(df.schema[date].dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        raise InputError(f"{date} must be a date, got {df.schema[date].dataType.simpleString()}.")
    name = F.lit("series") if series_id is None else F.col(series_id) if isinstance(series_id, str) else series_id
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    meta = {k: x for k, x in df.schema[value].metadata.items() if k == WINDOW_KEY}
    return df.select(name.cast("string").alias("series_id"), F.col(date).cast("date").alias("date"), v.alias("value", metadata=meta))


def panel(df: DataFrame, date: str = "date", asset_id: str = "asset_id", value: str = "value", check: bool = True) -> DataFrame:
    """The table as ``date, asset_id, value`` with a double value; NaN becomes null.

    With ``check`` an eager pass rejects infinite and huge values, and cells that come twice:
    those would count twice in every product and mean.
    """
    out = series(df, asset_id, date, value).select("date", F.col("series_id").alias("asset_id"), "value")
    if check:
        need_unique_cells(out)
        if out.filter(F.abs("value") > LARGEST).limit(1).collect():
            raise InputError(f"{value} has values that are infinite or beyond {LARGEST:g}.")
    return out


def need_unique_cells(cells: DataFrame) -> None:
    """An error if a panel has two rows of one date and asset."""
    twice = cells.groupBy("date", "asset_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise InputError(f"The panel has {twice[0]['count']} rows for {twice[0]['asset_id']} on {twice[0]['date']}; keep one a cell.")


def window_of(df: DataFrame) -> int | None:
    """The rolling window that made ``value``, if its metadata says so."""
    w = df.schema["value"].metadata.get(WINDOW_KEY)
    return int(w) if w is not None and int(w) > 1 else None


def problems(df: DataFrame) -> DataFrame:
    """Diagnostics of a series table: duplicate dates, infinite values, and sizes beyond 1e100."""
    per = df.groupBy("series_id", "date").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("top"))
    kinds = F.array(
        F.struct(F.lit("duplicate_date").alias("kind"), (F.col("n") > 1).alias("bad")),
        F.struct(F.lit("infinite").alias("kind"), (F.col("top") == F.lit(float("inf"))).alias("bad")),
        F.struct(F.lit("too_large").alias("kind"), ((F.col("top") > LARGEST) & (F.col("top") < F.lit(float("inf")))).alias("bad")),
    )
    found = per.select("series_id", F.explode(kinds).alias("k")).filter("k.bad").groupBy("series_id", F.col("k.kind").alias("kind")).agg(F.count(F.lit(1)).alias("count"))
    return found.withColumn("message", F.concat(F.col("count").cast("string"), F.lit(" date(s): "), F.col("kind")))


def checked(df: DataFrame) -> DataFrame:
    """The same table, once an eager pass has found no problem in it."""
    bad = problems(df).limit(1).collect()
    if bad:
        raise InputError(f"series {bad[0]['series_id']}: {bad[0]['message']}. Remove or repair those rows.")
    return df

