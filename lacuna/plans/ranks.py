"""Places and running sums in a global order, without a task that holds all rows.

The order is cut at values of a bounded, hash-chosen sample, so that a row's
part is an expression of the row alone: recomputed tasks and reused plans agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: About so many rows are looked at to cut the order into parts of so many rows, of which there are at most so many.
SAMPLE_ROWS = 4000
PART_ROWS = 200_000
MAX_PARTS = 256


def part_of(df: DataFrame, order: list[str]) -> Column:
    """The part (0, 1, ...) of each row: how many cuts lie below it in ascending order of the columns, NULL first."""
    n = df.count()
    parts = min(MAX_PARTS, math.ceil(n / PART_ROWS))
    if parts < 2:
        return F.lit(0)
    slot = F.pmod(F.xxhash64(F.lit("cut"), *order), F.lit(1 << 30))
    some = df.filter(slot < math.ceil((1 << 30) * min(1.0, SAMPLE_ROWS / n))).select(*order).distinct().orderBy(*order).collect()
    cuts = [some[i * len(some) // parts] for i in range(1, parts)] if len(some) >= parts else some
    kinds = {c: df.schema[c].dataType for c in order}
    at = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order]) for r in cuts])
    own = F.struct(*[F.col(c) for c in order])
    return F.size(F.filter(at, lambda c: c < own)) if cuts else F.lit(0)


def running(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each one; rows equal in ``order`` stand in any order."""
    rows = df.withColumn("_part", part_of(df, order)).withColumn("_value", value)
    sums = rows.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row per part
    starts = F.broadcast(sums.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_start")))
    inside = F.sum("_value").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    return placed.join(starts, F.col("_part") == F.col("_of")).withColumn(out, F.col("_start") + F.col("_inside")).drop("_part", "_of", "_start", "_inside", "_value")


def numbered(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Adds each row's place (from 1) in the order of the given keys."""
    names = [f"_order{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    return running(keyed, names, F.lit(1).cast("long"), "_before").withColumn(out, F.col("_before") + 1).drop("_before", *names)


def counted(df: DataFrame, value: str, *sums: Column) -> DataFrame:
    """(v, c, sums..): each distinct value with its count and the given sums."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"), *sums)


def ranked(df: DataFrame, value: str, *sums: Column) -> DataFrame:
    """(v, c, sums.., rank): each distinct value with its count, the given sums and its average rank."""
    return ranked_counts(counted(df, value, *sums))


def ranked_counts(x: DataFrame) -> DataFrame:
    """The distinct values of ``counted`` with their average ranks."""
    return running(x, ["v"], F.col("c"), "_before").withColumn("rank", F.col("_before") + (F.col("c") + 1) / 2).drop("_before")
