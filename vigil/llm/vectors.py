"""Which rows of an embedding column take part, and their vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(column: str) -> Column:
    """Not null, and all components finite, but not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


def usable_rows(df: DataFrame, column: str) -> DataFrame:
    """Usable rows of the most frequent length, of the larger of two equally frequent ones."""
    rows = df.where(usable(column))
    common = rows.groupBy(F.size(column).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size(column) == (common["size"] if common else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
