"""Walking the texts of Arrow batches as byte arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; numpy temporaries take up to some 60 times that.
SLICE = 1 << 20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (one more than rows); null: empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with some ``limit`` bytes of text each (a longer text stands alone), as (rows,
    their bytes end to end, offsets from 0)."""
    if not batch.num_rows:
        return
    data, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def texts(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    """Each row's text as bytes; null: empty."""
    for value in batch.column(text).cast(pa.large_binary()):
        yield value.as_py() or b""
