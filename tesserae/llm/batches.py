"""Helpers for Arrow batches that hold texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a longer text makes a step of its own.
STEP_BYTES = 2 << 20


def text_steps(batches: Iterator[pa.RecordBatch], within: str | None = None, size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, text bytes, offsets) with at most about `size` bytes of text each; a null text is empty.

    The texts are those of the column text, or of the field text in the struct column `within`.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        col = pc.struct_field(batch.column(names.index(within)), "text") if within else batch.column(names.index("text"))
        if col.type != pa.large_string():
            col = col.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def strings_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
