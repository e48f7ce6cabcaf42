"""Python functions over Arrow batches, a bounded piece at a time.

A batch has up to 10,000 rows, whatever their length. Turned into Python's strings as one, with the
results beside it, it takes many times its size in every worker; so a piece of a batch goes in,
and its results are sent off, before the next is touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes and rows of a piece; a longer row is a piece by itself.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 256


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """A column of strings, binaries or arrays in consecutive slices of PIECE_BYTES and PIECE_ROWS at most."""
    nested = pa.types.is_list(column.type)
    size = pc.fill_null((pc.list_value_length if nested else pc.binary_length)(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64) * (4 if nested else 1))
    i, before = 0, 0
    while i < len(ends):
        j = min(len(ends), i + PIECE_ROWS, max(i + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right"))))
        yield column.slice(i, j - i)
        i, before = j, int(ends[j - 1])


def by_pieces(f: Callable[[], Callable[[list], list]], returns: T.DataType):
    """An Arrow UDF of one column: f() makes, once a task, the function that maps the values of a piece, nulls included."""
    kind = to_arrow_type(returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g = f()
        for column in batches:
            for piece in pieces(column):
                yield pa.array(g(piece.to_pylist()), kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # this module's are strings
    return F.arrow_udf(run, returns)


def each(f: Callable, returns: T.DataType):
    """The same for a function of one value; nulls stay."""
    return by_pieces(lambda: lambda values: [None if x is None else f(x) for x in values], returns)
