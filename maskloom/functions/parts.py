"""Rows of an Arrow function in small parts, so that Python objects of a whole batch are never held at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: Rows of a part.
ROWS = 200


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers live on beside the executor's other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; its own ways have to do


def ranges(rows: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the parts; one empty part of no rows."""
    return ((k, min(ROWS, rows - k)) for k in range(0, max(rows, 1), ROWS))


def by_parts(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """f over Arrow arrays of one length, ROWS rows at a time."""

    @wraps(f)
    def run(*columns: pa.Array) -> pa.Array:
        out = pa.concat_arrays([f(*(c.slice(k, n) for c in columns)) for k, n in ranges(len(columns[0]))])
        release_memory()
        return out

    return run
