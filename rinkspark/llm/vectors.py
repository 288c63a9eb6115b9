"""What operators on vectors share: which vectors take part, and reading them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not NULL, not empty, no NULL or non-finite component."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``vec`` (doubles) of the rows that take part."""
    return vectors.filter(usable(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix for each vector length in the batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, values[starts[rows][:, None] + np.arange(size)]))
    return out
