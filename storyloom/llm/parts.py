"""Rows that Spark shuffles many at a time: those of one part of a batch are one row, with the bytes of each column.

A table of numbers that is dealt out by a key, grouped in numpy and used once costs most in making a row of each few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .links import partitions_for

#: Rows of a part, on average, at most; a task holds one part at once.
PART_ROWS = 1 << 17


def parts_for(df: DataFrame, rows: int) -> int:
    """Into how many parts so many rows are dealt: some for each partition, so that these are of like size."""
    return max(2 * partitions_for(df), -(-rows // PART_ROWS))


def schema(columns: int) -> str:
    return "part int, " + ", ".join(f"c{k} binary" for k in range(columns))


def packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each part, with the bytes of its rows in each column."""
    small = part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part
    order = np.argsort(small, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    edges = np.append(first, len(part))
    out = [pa.array(part[first].astype(np.int32))]
    for c in columns:
        width = c.dtype.itemsize * (c.shape[1] if c.ndim > 1 else 1)
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c[order]))]))
    return pa.RecordBatch.from_arrays(out, names=["part", *[f"c{k}" for k in range(len(columns))]])


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by part -> the columns of each part, with numbers of ``kinds``."""
    now, held = None, [[] for _ in kinds]
    for batch in batches:
        part = batch.column(0).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(part)]):
            if now is not None and part[a] != now:
                yield [np.concatenate(h) for h in held]
                held = [[] for _ in kinds]
            now = part[a]
            for h, kind, c in zip(held, kinds, batch.columns[1:]):
                _, offsets, data = c.buffers()
                lo, hi = np.frombuffer(offsets, np.int32)[[c.offset + a, c.offset + z]].tolist()
                h.append(np.frombuffer(data, np.uint8)[lo:hi].view(kind) if hi > lo else np.zeros(0, kind))
    if now is not None:
        yield [np.concatenate(h) for h in held]
