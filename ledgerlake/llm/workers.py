"""Keeping Python workers small: Spark reuses them from stage to stage."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa


def tidy() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokens: bool = False):
    """An Arrow function that tidies up after its task; all but tokenising ones first drop
    the vocabularies that an earlier stage left in the worker."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokens and sys.modules.pop("_ledgerlake_encoders", None) is not None:
            tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return task
