"""Vector columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(c: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each vector length; the rows must be ``usable``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = np.asarray(column.flatten()).astype(np.float64)
    first = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, values[(first[rows][:, None] + np.arange(n)).reshape(-1)].reshape(-1, n)))
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
