"""Arrow batches in workers: bounded in bytes, and memory given back at a task's end."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker takes on at once, unless one text has more.
BATCH_BYTES = 4 << 20


#: Fixed values of the C library's mallopt: number of arenas, size from which a block is mapped by itself, free
#: bytes at the top of the heap that are kept.
_ARENAS, _MAPPED_FROM, _KEPT_AT_TOP = -8, -3, -1
_settled: list[bool] = []


def _settle() -> None:
    """Once in a worker: large blocks go back to the system when they are freed, not to pools for later."""
    if not _settled:
        _settled.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
            library = ctypes.CDLL(None)
            for what, value in ((_ARENAS, 1), (_MAPPED_FROM, 1 << 20), (_KEPT_AT_TOP, 1 << 20)):
                library.mallopt(what, value)


_kept: list[dict] = []


def kept() -> dict:
    """A place for what a worker keeps from task to task. It is emptied when a task begins that doesn't use it:
    a worker serves one query after another, and would hold the tables of all of them."""
    _kept.append({})
    return _kept[-1]


def bounded(source: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES, uses: tuple[dict, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of at most ``most`` bytes in a column of strings. At the end, what the
    allocators hold for later goes back to the system: the worker may be idle for long. Of what is ``kept``,
    only what the task ``uses`` stays."""
    _settle()
    for place in _kept:
        if not any(place is used for used in uses):
            place.clear()
    try:
        for batch in source:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0)
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(ends):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
                yield batch.slice(at, end - at)
                at = end
    finally:
        give_back()


def give_back() -> None:
    """Returns what the allocators hold for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
