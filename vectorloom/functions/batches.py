"""Parts of Arrow batches. Spark bounds what it hands to Python by bytes; what Python hands back is
bounded here, so no operator needs a batch size of the session of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, BYTES = 1024, 4 << 20


def slices(batch: pa.RecordBatch, column: int | str | None = None, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most `rows` rows, with about `size` bytes in a text or binary `column`; a longer value is a part of its own."""
    n = batch.num_rows
    ends = np.zeros(n, np.int64)
    if column is not None:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < n:
        limit = (ends[at - 1] if at else 0) + size
        stop = min(at + rows, n, max(at + 1, int(np.searchsorted(ends, limit, "right"))))
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()  # idle workers keep what is not given back
