"""Embeddings as integer matrices: what the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def finite(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(is_finite(F.col(column)))


def dimensions(rows: DataFrame, column: str) -> int:
    """The length of the longest vector; shorter ones are filled up with zeros."""
    return rows.agg(F.max(F.size(column)).alias("d")).first()["d"] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column of lists as rows of doubles; shorter vectors are filled up with zeros."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def floored(column: pa.Array, width: int, factor: int, limit: int) -> np.ndarray:
    """floor(factor * c) of every component as whole numbers, at most `limit` from zero."""
    return np.clip(np.floor(matrix(column, width) * factor), -limit, limit).astype(np.int64)
