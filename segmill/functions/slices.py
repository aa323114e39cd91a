"""Python functions over Arrow batches, a slice at a time: what a worker holds as Python objects doesn't grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of a slice, a row counting as ROW bytes besides its texts; a longer row is a slice of its own.
SLICE, ROW = 1 << 20, 256


def slices(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """(first row, rows) of each slice of columns of equal length."""
    n = len(columns[0])
    size = np.full(n, ROW, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
        elif n:
            size += c.nbytes // n
    upto = np.cumsum(size)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
        yield at, stop - at
        at = stop


def over_slices(of: Callable, columns: list[pa.Array], to: pa.DataType) -> pa.Array:
    """of(slices of columns), put together."""
    parts = [of(*(c.slice(*at) for c in columns)) for at in slices(columns)]
    return pa.concat_arrays(parts) if parts else pa.array([], to)


def sliced(kind: DataType) -> Callable:
    """A function of Python values as one of columns, with results of type kind; it runs over slices of the batches."""

    def over(one: Callable) -> Callable:
        @F.arrow_udf(kind)
        def of(*columns: pa.Array) -> pa.Array:
            to = to_arrow_type(kind)
            return over_slices(lambda *own: pa.array(map(one, *(c.to_pylist() for c in own)), to), columns, to)

        return of

    return over
