"""Bounded parts of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of string or binary values; nulls are empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return values[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches, column: str, most: int):
    """(rows, bytes, bounds) for parts of batches that hold up to `most` bytes of a column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends, at = np.cumsum(np.concatenate(([0], sizes)), dtype=np.int64), 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            part = batch.slice(at, to - at)
            yield part, *flat_bytes(part.column(column))
            at = to
