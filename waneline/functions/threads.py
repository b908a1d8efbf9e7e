"""One BLAS thread for each Python worker: Spark already runs a worker for each core."""

from __future__ import annotations

import ctypes
import functools
from pathlib import Path

import numpy as np

_SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@functools.cache
def one_thread() -> bool:
    """Whether numpy's own OpenBLAS was found and told to use one thread in this process."""
    told = False
    for lib in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        try:
            handle = ctypes.CDLL(str(lib))
        except OSError:
            continue
        for name in _SETTERS:
            if hasattr(handle, name):
                getattr(handle, name)(ctypes.c_int(1))
                told = True
    return told
