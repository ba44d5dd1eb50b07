"""What the vector operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """Whether a vector takes part: not null or empty, every component a finite number, not all zero."""
    v = F.col(c)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def doubles(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.col(c).cast("array<double>"))


def finite(c: str) -> Column:
    """Whether a vector is there and every component a finite number (it may be empty or zero)."""
    v = F.col(c)
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) of the vectors of each length; none may be null or hold a null."""
    lists = lists.cast(pa.list_(pa.float64()))
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[(first[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
