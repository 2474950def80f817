"""How an estimator meets degenerate tables: fits, refuses clearly, or goes wrong."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.auto import Estimator

#: Words of which a clear refusal uses at least one.
CLEAR = ("observed", "rows", "feature", "class", "infinite", "penalty", "identify", "columns", "value", "missing", "numbers", "labels", "blocks", "patterns")
#: Regimes that a family is known to refuse, and why.
DECLARED = {("linear", "wide"): "without a penalty more features than rows cannot be identified"}


def _table(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> DataFrame:
    names = [f"x{j + 1}" for j in range(x.shape[1])]
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], None if math.isnan(o) else float(o), i % 4) for i, (r, o) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names) + ", y double, g int")


def regimes(task: str = "regression", seed: int = 0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The degenerate tables as arrays; NaN is missing."""
    rng = np.random.default_rng(seed)
    n, p = 120, 5

    def outcome(x: np.ndarray) -> np.ndarray:
        y = x @ np.linspace(1, -1, x.shape[1]) + 0.4 * rng.normal(size=len(x))
        return (y > np.median(y)).astype(float) if task == "classification" else y

    def holes(x: np.ndarray, rate: float) -> np.ndarray:
        return np.where(rng.random(x.shape) < rate, np.nan, x)

    x = rng.normal(size=(n, p))
    y = outcome(x)
    out = {f"missing_{round(100 * r)}": (holes(x, r), y) for r in (0.15, 0.5, 0.7, 0.9)}
    one = holes(x, 0.1)
    one[np.arange(n), np.arange(n) % p] = np.nan
    out["no_complete_row"] = (one, y)
    empty = holes(x, 0.15)
    empty[:, 2] = np.nan
    out["empty_column"] = (empty, y)
    flat = holes(x, 0.15)
    flat[:, 1] = 3.0
    out["constant"] = (flat, y)
    twin = x.copy()
    twin[:, 3] = twin[:, 0]
    out["collinear"] = (holes(twin, 0.15), y)
    wide = rng.normal(size=(25, 40))
    out["wide"] = (holes(wide, 0.1), outcome(wide))
    tiny = rng.normal(size=(12, 3))
    out["tiny"] = (holes(tiny, 0.1), outcome(tiny))
    out["single_feature"] = (holes(x[:, :1], 0.2), outcome(x[:, :1]))
    out["missing_outcome"] = (holes(x, 0.15), np.where(rng.random(n) < 0.2, np.nan, y))
    rare = np.zeros(n)
    rare[:6] = 1
    out["rare_class"] = (holes(x, 0.15), rare if task == "classification" else y)
    out["scales"] = (holes(x, 0.15) * np.array([1e6, 1, 1e-6, 1, 1]), y)
    cell = holes(x, 0.15)
    cell[:, 4] = np.nan
    cell[7, 4] = 1.0
    out["one_observed_cell"] = (cell, y)
    blocks = x.copy()
    blocks[: n // 2, :2] = np.nan
    blocks[n // 2 :, 3:] = np.nan
    out["blockwise"] = (blocks, y)
    return out


def clear(error: Exception) -> bool:
    """Whether an error speaks of the data or a parameter."""
    return isinstance(error, (ValueError, TypeError)) and any(w in str(error) for w in CLEAR) and "Traceback" not in str(error) and "JVM" not in str(error)


def check(spark: SparkSession, estimator: Estimator, task: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(regime, outcome, detail, declared): fitted, refused clearly, refused opaquely, or nonsense (a prediction that is no number)."""
    rows = []
    for name, (x, y) in regimes(task).items():
        if names and name not in names:
            continue
        df = _table(spark, x, y)
        if task == "classification":
            df = df.withColumn("y", F.col("y").cast("int"))
        features = [f"x{j + 1}" for j in range(x.shape[1])]
        declared = DECLARED.get((estimator.family, name))
        try:
            model = estimator.fit(df, features, "y", key="k", group="g" if estimator.family == "mixed" else None)
            bad = model.transform(df).filter(F.col("prediction").isNull() | F.isnan(F.col("prediction").cast("double"))).count()
            rows.append((name, "nonsense" if bad else "fitted", f"{bad} rows without a prediction" if bad else "", declared))
        except Exception as e:  # every way to fail is an outcome here
            rows.append((name, "refused clearly" if clear(e) else "refused opaquely", str(e)[:200], declared))
    return spark.createDataFrame(rows, "regime string, outcome string, detail string, declared string")


def problems(report: DataFrame) -> DataFrame:
    """Rows that a sound estimator does not have: nonsense and opaque refusals that nobody declared."""
    return report.filter(F.col("outcome").isin("nonsense", "refused opaquely") & F.col("declared").isNull())


def deterministic(df: DataFrame, key: str, fit: Callable[[DataFrame], object], rtol: float = 1e-6) -> DataFrame:
    """(variant, largest): the largest relative gap of predictions after a second fit, and a fit on shuffled partitions."""

    def predicted(rows: DataFrame) -> DataFrame:
        return fit(rows).transform(df).select(F.col(key).alias("_k"), F.col("prediction").cast("double").alias("_p"))

    base = predicted(df).withColumnsRenamed({"_k": "_k0", "_p": "_p0"})
    parts = []
    for name, rows in (("again", df), ("shuffled", df.repartition(7, F.xxhash64(F.lit("shuffle"), key)))):
        gap = F.max(F.abs(F.col("_p") - F.col("_p0")) / (1 + F.abs("_p0")))
        parts.append(predicted(rows).join(base, F.col("_k") == F.col("_k0")).agg(gap.alias("largest")).select(F.lit(name).alias("variant"), "largest", (F.coalesce(F.col("largest"), F.lit(0.0)) <= rtol).alias("same")))
    return parts[0].unionAll(parts[1])
