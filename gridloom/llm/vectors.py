"""Vectors of a table as numpy blocks, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is not null and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(~bad)


def matrices(ids: pa.Array, column: pa.Array):
    """(ids, matrix) for every length of vectors in an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    numbers = ids.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        if len(rows) == len(lengths):
            yield numbers, values[offsets[0] : offsets[-1]].reshape(-1, d)
        else:
            yield numbers[rows], values[offsets[rows][:, None] + np.arange(d)]
