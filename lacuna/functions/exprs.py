"""Column expressions that need no Python on the executors."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import numerics
from lacuna.functions.numerics import gauss_hermite


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_sigmoid(x: Column) -> Column:
    """-log(1 + exp(-x)), x clipped to +-500."""
    return -F.log1p(F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def logistic_normal(a: Column, v: Column, n: int = 20) -> Column:
    """E sigmoid(a + t), t ~ N(0, v), for v <= 1: a fixed sum over Gauss-Hermite nodes."""
    t, w = gauss_hermite(n)
    total = F.lit(0.0)
    for node, weight in zip(t.tolist(), w.tolist(), strict=True):
        total = total + F.lit(weight) * sigmoid(a + F.sqrt(v) * F.lit(node))
    return F.when(v <= 1e-12, sigmoid(a)).otherwise(F.greatest(F.least(total, F.lit(1 - 1e-15)), F.lit(1e-15)))


def wide_logistic_normal(a: Column, v: Column) -> Column:
    """E sigmoid(a + t), t ~ N(0, v), for any v >= 0, in Arrow batches."""

    @F.pandas_udf("double")
    def run(mean: pd.Series, variance: pd.Series) -> pd.Series:
        known = mean.notna() & variance.notna()
        found = numerics.logistic_normal(mean.fillna(0.0).to_numpy(float), variance.fillna(0.0).to_numpy(float))
        return pd.Series(found, index=mean.index).where(known, None)

    return run(a, v)


def normal_log_density(x: Column, mean: Column, variance: Column) -> Column:
    return -0.5 * (F.lit(math.log(2 * math.pi)) + F.log(variance) + (x - mean) * (x - mean) / variance)


def sqrt_or_null(v: Column) -> Column:
    return F.when(v > 0, F.sqrt(v))


def mask(columns: list[str]) -> Column:
    """The missingness pattern as text, one 0 (observed) or 1 (missing) per column."""
    return F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
