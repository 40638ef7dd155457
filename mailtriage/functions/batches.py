"""Arrow batches in small slices, so that what a Python worker holds does not grow with a batch's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows and bytes of a slice. One row counts however long it is.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def slices(data: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch or array in slices of about SLICE_BYTES and of SLICE_ROWS at most; none of an empty one."""
    n = len(data) if isinstance(data, pa.Array) else data.num_rows
    each = max(1, min(SLICE_ROWS, n * SLICE_BYTES // max(1, data.nbytes)))
    for begin in range(0, n, each):
        yield data.slice(begin, min(each, n - begin))


def by_slices(change: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """change, which maps an array row by row, slice by slice."""

    def whole(data: pa.Array) -> pa.Array:
        parts = [change(part) for part in slices(data)]
        return pa.concat_arrays(parts) if parts else change(data)

    return whole
