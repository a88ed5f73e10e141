"""Arrow batches cut by the bytes of their texts: a batch holds as many rows as Spark sends, however long their texts are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel turns into Python values at a time; a longer text is alone.
TEXT_BYTES = 4 << 20


def bounded(batches: Iterable[pa.RecordBatch], column: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices whose ``column`` of strings or binaries holds at most ``limit`` bytes, or one row."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop
