"""The tabulated null distribution of the sup-Wald statistic, computed once in a process.

No numbers are stored in the source and none are drawn: see ``stats.sup_wald_cdf``.
"""

from __future__ import annotations

import functools

from waneline.functions.errors import InputError
from waneline.functions.stats import SUP_WALD_TRIMS, sup_wald_quantiles


@functools.cache
def quantiles(trim: float) -> list[float]:
    """Quantiles at SUP_WALD_LEVELS for one of the tabulated trims."""
    if trim not in SUP_WALD_TRIMS:
        raise InputError(f"trim must be one of {SUP_WALD_TRIMS}, got {trim!r}.")
    return sup_wald_quantiles(trim)
