"""What Python workers hold between tasks.

Spark keeps idle workers for later tasks, whatever their stage, and freed memory stays with a worker's
allocators: after a few stages all idle workers together can hold more than the one task that runs. A task
function made by ``tidied`` gives that memory back to the system when its last batch is out.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Freed memory of Arrow's and the C library's allocators goes back to the system, where the latter offers that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker gives back what it no longer uses."""
    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
