"""Embedding rows as integer vectors: which rows take part, and Arrow batches as matrices.

A component x becomes floor(256 * x), x as double. A row takes part if its vector is there and holds neither null nor
NaN nor infinity. Vectors shorter than the longest one count as filled up with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256.0


def whole(column: str = "embedding") -> Column:
    """The vector is there and all its entries are finite numbers."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def width(rows: DataFrame, column: str = "embedding") -> int:
    """The length of the longest vector: one number."""
    return rows.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The scaled and floored vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(np.asarray(column.offsets))
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
    if len(lens) and lens.min() == dims:
        return flat.reshape(-1, dims)
    out = np.zeros((len(lens), dims))
    out[np.arange(dims) < lens[:, None]] = flat
    return out
