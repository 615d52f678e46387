"""Arrow batches in pieces whose texts fit in memory as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, BYTES = 4096, 8 << 20


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of text in each row, in columns of texts and of lists of texts, also within structs; other columns count 8."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        total += _bytes_of(column)
    return total


def _bytes_of(column: pa.Array) -> np.ndarray | int:
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if pa.types.is_struct(kind):
        return sum((_bytes_of(field) for field in column.flatten()), np.zeros(len(column), np.int64))
    if pa.types.is_list(kind) and pa.types.is_string(kind.value_type):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        each = pc.fill_null(pc.binary_length(pc.list_flatten(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return ends[at[1:]] - ends[at[:-1]]
    return 8


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut after at most ``rows`` rows or ``size`` bytes of text; a row beyond that is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(row_bytes(batch))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            fit = int(np.searchsorted(ends, before + size, "right"))
            high = min(max(fit, low + 1), low + rows)
            yield batch.slice(low, high - low)
            low = min(high, batch.num_rows)
