"""Spark's tasks are the parallelism: numeric libraries keep to one thread in a worker."""

from __future__ import annotations

import ctypes
import functools

_NAMES = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@functools.cache
def one_thread() -> int:
    """Sets the linear algebra library that numpy has loaded to one thread, where it is OpenBLAS; how many libraries that were.

    On a cluster Spark limits workers by OMP_NUM_THREADS; in local mode nothing does.
    """
    import numpy  # noqa: F401  loads the library

    done = 0
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
        for path in paths:
            library = ctypes.CDLL(path)
            if setter := next((getattr(library, name) for name in _NAMES if hasattr(library, name)), None):
                setter(1)
                done += 1
    except OSError:  # another system: as it is
        pass
    return done
