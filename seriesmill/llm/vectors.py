"""Vectors as whole numbers, which sums and products keep exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame, vector: str, scale: int, most: int) -> DataFrame:
    """Column ``v``, ``floor(scale * x)`` of every component, for vectors that have a value in every component.

    Vectors that are NULL, empty, or hold a NULL or non-finite component are
    left out.  A result of ``most`` or more in size stops the job: sums of
    squares would leave the whole numbers that 64 bits hold.
    """
    x = F.col(vector)
    spoilt = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.where(x.isNotNull() & (F.size(x) > 0) & ~spoilt).withColumn("v", x.cast("array<double>"))
    return kept.withColumn("v", F.transform("v", lambda c: F.when(
        F.abs(c * F.lit(float(scale))) >= float(most),
        F.raise_error(F.lit(f"a component is {most} or more after scaling")).cast("bigint"),
    ).otherwise(F.floor(c * F.lit(float(scale))))))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a batch as rows; one of another length stops the job."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != width).any():
        raise ValueError(f"vectors of {sorted({width, *sizes.tolist()})} components in one table")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
