"""Vectors as the two embedding operators see them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null or zero, and all its components finite."""
    return F.coalesce(F.expr(
        f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vector}, x -> x <> 0)"), F.lit(False))


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix of doubles, scaled only where squares would overflow or vanish."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    largest = np.abs(matrix).max(axis=1, initial=0)
    extreme = (largest > 1e150) | (largest < 1e-150)
    if extreme.any():
        matrix[extreme] /= largest[extreme, None]
    return matrix
