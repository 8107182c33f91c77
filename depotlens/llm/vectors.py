"""Columns of vectors as matrices, for use in Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and float64 rows of the usable vectors in a list column, one pair for each length of vector.

    Left out are vectors that are null or empty, or hold a null, a NaN or an infinity.
    """
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        rows = flat.reshape(-1, length) if at.size == lengths.size else flat[starts[at][:, None] + np.arange(length)]
        usable = np.isfinite(rows).all(axis=1)
        yield at[usable], rows[usable]


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of the rows of a matrix."""
    ends = np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def longs(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
