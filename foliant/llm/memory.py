"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import gc


def give_back() -> None:
    """Return what a task has freed to the system, so that an idle worker doesn't hold it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass
