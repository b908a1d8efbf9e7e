"""Errors of eager checks, and the record of what lazy plans had to leave out.

Bad arguments raise at once. What depends on the data is reported as rows of a diagnostics
DataFrame (``series_id, kind, count, message``), since raising inside executors hides the cause.
"""

from __future__ import annotations


class WanelineError(Exception):
    """Base of all errors of this package."""


class InputError(WanelineError, ValueError):
    """An argument or table is not usable; the message says how to fix it."""


class AlignmentError(InputError):
    """Tables share no dates or assets, or a required date is missing."""


class FrequencyError(InputError):
    """Dates are irregular, or two tables differ in frequency."""


class InsufficientDataError(InputError):
    """Too few observations."""


class DownloadError(WanelineError, OSError):
    """A factor file could not be fetched."""


class WanelineWarning(UserWarning):
    """Base of all warnings of this package."""


class DataDroppedWarning(WanelineWarning):
    """Rows were left out; the message counts them."""


class FitWarning(WanelineWarning):
    """A fit fell back to a simpler model."""


DIAGNOSTICS = "series_id string, kind string, count long, message string"
