"""Memory of the Python workers, which Spark keeps from task to task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system, as far as the allocators can: an idle worker else holds its last task's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def reuse() -> None:
    """Have the allocator keep large blocks for the next array: mapping them anew costs several times what numpy does with them."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune:
        tune(-3, 1 << 28)  # blocks below this size are not mapped one by one
        tune(-1, 1 << 29)  # free memory above this size goes back at once


def released(run: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that releases memory when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def arrays(column: pa.Array | pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    """The values of a binary column without nulls, as arrays of dtype that share its memory."""
    out: list[np.ndarray] = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary())
        at = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data, size = chunk.buffers()[2], np.dtype(dtype).itemsize
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append(np.frombuffer(data, dtype, (b - a) // size, a) if b > a else np.zeros(0, dtype))
    return out
