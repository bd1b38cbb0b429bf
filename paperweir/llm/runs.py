"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of equal values in the first `keys` columns, with the runs' bounds.

    The input must be sorted by these columns. Only a run that crosses a batch is held over, so memory is
    bounded by a batch and the longest run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = starts(batch, keys)
        if held and not _joins(held[-1], batch, keys):
            yield _bounded(pa.Table.from_batches(held), keys)
            held = []
        if len(begins) == 1:
            held.append(batch)
            continue
        last = int(begins[-1])
        yield _bounded(pa.Table.from_batches([*held, batch.slice(0, last)]), keys)
        held = [batch.slice(last)]
    if held:
        yield _bounded(pa.Table.from_batches(held), keys)


def starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the runs of equal values in the first `keys` columns of a batch begin."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for i in range(keys):
        v = batch.column(i).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _joins(a: pa.RecordBatch, b: pa.RecordBatch, keys: int) -> bool:
    return all(a.column(i)[a.num_rows - 1] == b.column(i)[0] for i in range(keys))


def _bounded(t: pa.Table, keys: int) -> tuple[pa.Table, np.ndarray]:
    t = t.combine_chunks()
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for i in range(keys):
        v = t.column(i).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return t, np.r_[np.flatnonzero(change), t.num_rows]


def matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype: type) -> np.ndarray:
    """A binary column of equal sizes as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    size = width * np.dtype(dtype).itemsize
    n = len(column)
    if not n:
        return np.empty((0, width), dtype)
    first = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.binary() else np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + n * size].view(dtype).reshape(n, width)


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    n, size = len(rows), rows.shape[1] * rows.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
