"""What the vector operators share: which vectors take part, and exact sums of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; never null."""
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def whole(vec: Column, factor: float) -> Column:
    """``floor(factor * c)`` of every component, taken as double; longs at most."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * F.lit(float(factor))).cast("long"))


def kept(vectors: DataFrame, vec: str, x: Column) -> DataFrame:
    """(row, x): the rows whose vector is whole, as one struct each so that no names clash, with ``x``, an array made of the vector."""
    return vectors.select(F.struct("*").alias("row"), F.when(finite(F.col(vec)), x).alias("x")).filter(F.col("x").isNotNull())


def common_length(rows: DataFrame) -> tuple[int, int] | None:
    """The most frequent length of ``x``, of equally frequent ones the shortest, and how many rows have it; None without rows."""
    found = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (found["d"], found["n"]) if found else None


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.int64) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of whole numbers, exact."""
    if not len(x):
        return [0] * x.shape[1]
    if x.dtype != object and int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) >= 1 << 62:
        x = x.astype(object)
    return [int(v) for v in x.sum(0)]


#: Sums travel as two longs, high * 2^32 + low, which add without overflow.
LOW = 32


def limbs(values: list[int]) -> tuple[list[int], list[int]]:
    return [v >> LOW for v in values], [v & ((1 << LOW) - 1) for v in values]


def unlimbed(high: list[int], low: list[int]) -> list[int]:
    return [(int(a) << LOW) + int(b) for a, b in zip(high, low, strict=True)]


def as_long(value: int) -> int:
    """The nearest long."""
    return max(-(1 << 63), min((1 << 63) - 1, int(value)))
