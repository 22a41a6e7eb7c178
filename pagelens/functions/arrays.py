"""Arrays of each row in one pass: what would otherwise take a window over exploded rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tools():
    """Functions that go to the tasks by value, so that workers needn't find this package."""

    def flat(a: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        """(offsets from 0 on, elements) of a list array, which can be a slice; a null list is empty."""
        if a.null_count:
            a = pc.fill_null(a, pa.scalar([], a.type))
        at = a.offsets.to_numpy()
        return at - at[0], a.values.slice(at[0], at[-1] - at[0])

    def before(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of the sizes before each element within its list."""
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return total[:-1] - np.repeat(total[at[:-1]], np.diff(at))

    return flat, before


def running(sizes: Column) -> Column:
    """For each element the sum of those before it."""
    flat, before = _tools()

    @F.arrow_udf("array<bigint>")
    def run(a: pa.Array) -> pa.Array:
        at, v = flat(a)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(before(at, v.to_numpy(zero_copy_only=False)), pa.int64()))

    return run(sizes)
