"""Arrays of many rows laid end to end, as Arrow holds them: so many elements at a time, with their rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Elements that are worked on at a time; a longer row is worked on alone.
SLICE = 1 << 18


def slices(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` elements."""
    ends = lists.offsets.to_numpy()
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, "right")) - 1)
        yield start, stop
        start = stop


def lengths_of(lists: pa.Array) -> np.ndarray:
    """Elements of each row; no row is null."""
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def list_of(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)
