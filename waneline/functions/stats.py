"""Statistical building blocks as Column expressions.

Robust standard errors rest on one fact: an OLS coefficient is a weighted sum of the
observations, so its Newey-West variance is the Bartlett-weighted sum of the products of
z_t = weight_t * residual_t. ``bartlett`` computes that from an ordered array, inside the JVM,
for any regression whose weights have a closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waneline.functions.errors import InputError
from waneline.functions.model import need_int

#: CDF levels at which the sup-Wald null distribution is tabulated: denser to the right.
SUP_WALD_LEVELS = sorted({round(k / 100, 6) for k in range(1, 81)} | {round(0.8 + k / 500, 6) for k in range(96)} | {round(0.99 + k / 2000, 6) for k in range(19)} | {0.9995})
SUP_WALD_TRIMS = (0.05, 0.10, 0.15, 0.20, 0.25)
P_FLOOR = 0.0005


def default_lags(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9))."""
    return F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")


def lags(n: Column, hac_lags: int | None, floor: Column | int = 0) -> Column:
    """The given lags, or the default rule raised to the floor; at most n - 1.

    Given ones must be below n and cover the overlap that the floor stands for: fewer would
    understate errors. What can be told from the arguments is an error at once, the rest in the plan.
    """
    if hac_lags is not None:
        need_int("hac_lags", hac_lags, 0)
        if isinstance(floor, int) and hac_lags < floor:
            raise InputError(f"hac_lags must be at least {floor} to cover overlapping windows, got {hac_lags}.")
        given, low = F.lit(hac_lags), F.lit(floor) if isinstance(floor, int) else floor
        wrong = F.concat(F.lit(f"hac_lags = {hac_lags} must be below the number of observations, "), n.cast("string"), F.lit(", and at least the overlap, "), low.cast("string"))
        return F.when((given >= n) | (given < low), F.raise_error(wrong).cast("int")).otherwise(given).cast("int")
    least = F.least(F.lit(floor) if isinstance(floor, int) else floor, n - 1)
    return F.greatest(default_lags(n), least).cast("int")


def bartlett(z: Column, lag: Column) -> Column:
    """sum z_t^2 + 2 sum_{l=1..L} (1 - l / (L + 1)) sum_t z_t z_{t-l} of an array in time order."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    n = F.size(z)
    own = dot(z, z)
    cross = F.aggregate(
        F.when(lag >= 1, F.sequence(F.lit(1), lag)).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, k: acc + F.lit(2.0) * (F.lit(1.0) - k / (lag + F.lit(1.0))) * dot(F.slice(z, k + 1, F.greatest(n - k, F.lit(0))), F.slice(z, F.lit(1), F.greatest(n - k, F.lit(0)))),
    )
    return own + cross


def se(z: Column, lag: Column) -> Column:
    """Standard error from the weighted residuals; null where it is zero."""
    v = F.greatest(bartlett(z, lag), F.lit(0.0))
    return F.when(v > 0, F.sqrt(v))


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: Maclaurin series to 4, then 0 within 2e-8."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(140)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda acc, n: F.struct((acc["term"] * (-x * x / n)).alias("term"), (acc["sum"] + acc["term"] * (-x * x / n) / (2 * n + 1)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(x < 4.0, F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * terms)).otherwise(F.when(x.isNotNull(), F.lit(0.0)))


def chi2_sf(w: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return _erfc(F.sqrt(w / 2.0))


def kolmogorov_sf(x: Column) -> Column:
    """Upper tail of the Kolmogorov distribution."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * x * x))
    return F.when(x < 0.04, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def sup_wald_cdf(stat, trim: float, modes: int = 64):
    """Chance that the sup-Wald statistic stays below each of ``stat`` under no break, without simulation.

    A Brownian bridge over its deviation is, in the time ln(p / (1 - p)) / 2, a stationary
    Ornstein-Uhlenbeck process; the statistic stays below c^2 if that process, run for
    ln((1 - trim) / trim), never leaves (-c, c). Killed there, it decays along the even states
    of a harmonic oscillator between walls at -c and c, found in a cosine basis.
    """
    import numpy as np

    c = np.sqrt(np.asarray(stat, float))[:, None, None]
    node, weight = np.polynomial.legendre.leggauss(4 * modes)
    k = (np.arange(modes) + 0.5) * math.pi
    shape = np.cos(np.multiply.outer(k, node))  # orthonormal on (-1, 1), zero at the ends
    square = (shape * weight * node**2) @ shape.T
    energy, state = np.linalg.eigh(np.eye(modes) * (k / c) ** 2 + c**2 / 4 * square - np.eye(modes) / 2)
    x = c[:, 0] * node
    root = np.exp(-(x**2) / 4) * (2 * math.pi) ** -0.25  # of the normal density
    start = np.sqrt(c[:, 0]) * (root * weight) @ shape.T
    held = np.einsum("im,imj->ij", start, state) ** 2
    return (held * np.exp(-energy * math.log((1 - trim) / trim))).sum(1)


#: Dates on which the tabulated statistic looks for its greatest value; published tables rest on walks of about so many.
SUP_WALD_STEPS = 5_000
#: Fixed value, -zeta(1/2) / sqrt(2 pi): a walk of small steps overshoots a level by this share of a step's deviation.
OVERSHOOT = 0.5825971579390106


def sup_wald_quantiles(trim: float, steps: int | None = SUP_WALD_STEPS) -> list[float]:
    """Quantiles of the sup-Wald null distribution at SUP_WALD_LEVELS, for so many dates (None: without end).

    Between its dates a walk goes unseen, so its greatest value falls short of the process' by
    the mean overshoot; the deviation of a step is averaged over the process' time.
    """
    import numpy as np

    grid = np.linspace(0.6, 8.0, 1500)  # roots of the statistic
    below = np.concatenate([sup_wald_cdf(part**2, trim) for part in np.array_split(grid, 30)])
    if steps is not None:
        deviation = 2 * (1 - 2 * trim) / math.sqrt(trim * (1 - trim)) / math.log((1 - trim) / trim) / math.sqrt(steps)
        grid = grid - OVERSHOOT * deviation
    at = np.flatnonzero(np.append(True, np.diff(np.maximum.accumulate(below)) > 0))
    return [round(float(q), 4) for q in np.interp(SUP_WALD_LEVELS, below[at], grid[at]) ** 2]


def sup_wald_p(stat: Column, trim: float) -> Column:
    """p-value of a sup-Wald statistic by linear interpolation in the tabulated distribution."""
    from waneline.functions.supwald import quantiles

    q = quantiles(trim)
    table = F.array(*[F.struct(F.lit(a).alias("q0"), F.lit(b).alias("q1"), F.lit(c).alias("l0"), F.lit(d).alias("l1")) for a, b, c, d in zip(q, q[1:], SUP_WALD_LEVELS, SUP_WALD_LEVELS[1:], strict=False)])
    cell = F.element_at(F.filter(table, lambda c: (stat >= c["q0"]) & (stat < c["q1"])), 1)
    inner = F.lit(1.0) - (cell["l0"] + (cell["l1"] - cell["l0"]) * (stat - cell["q0"]) / (cell["q1"] - cell["q0"]))
    return F.when(stat.isNull(), F.lit(None).cast("double")).when(stat <= q[0], F.lit(1 - SUP_WALD_LEVELS[0])).when(stat >= q[-1], F.lit(P_FLOOR)).otherwise(inner)
