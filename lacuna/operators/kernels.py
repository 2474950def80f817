"""Support vector machines for bounded tables.

Exact kernels cost n^2 memory and n^3 time, so fits refuse more than ``MAX_ROWS``
labelled rows.  Predictions run over any number of rows in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.checks import check_choice, check_positive_float
from lacuna.functions.numerics import lbfgs, normal_quantile, sigmoid
from lacuna.plans.patterns import degenerate, profile

MAX_ROWS = 1500


def _training(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = df.filter(F.col(label).isNotNull()).select(*features, label).orderBy(label, *features).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"exact kernels take at most {MAX_ROWS} labelled rows")
    return _standardised(df, features, label, rows)


def _standardised(df: DataFrame, features: list[str], label: str, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    prof = profile(df, features)
    center = np.array([prof[c]["mean"] or 0.0 for c in features])
    scale = np.array([1.0 if degenerate(prof[c]) else prof[c]["sd"] for c in features])
    x = np.array([[np.nan if r[c] is None else r[c] for c in features] for r in rows], float).reshape(len(rows), len(features))
    return (x - center) / scale, np.array([float(r[label]) for r in rows]), center, scale


def _distinct(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_training``, but every distinct row once, with (third) how many rows it stands for, and none refused."""
    groups = df.filter(F.col(label).isNotNull()).groupBy(*features, label).agg(F.count("*").alias("_count"))
    rows = groups.orderBy(label, *features).collect()
    x, y, center, scale = _standardised(df, features, label, rows)
    return x, y, np.array([float(r["_count"]) for r in rows]), center, scale


def kernel(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Product RBF kernel of standardised rows; a missing coordinate is integrated over N(0, 1)."""
    out = np.ones((len(a), len(b)))
    for j, ell in enumerate(lengths):
        x, y = a[:, j][:, None], b[:, j][None]
        both = np.exp(-0.5 * ((x - y) / ell) ** 2)
        seen = np.where(np.isnan(x), y, x)
        one = ell / math.sqrt(ell**2 + 1) * np.exp(-(seen**2) / (2 * (ell**2 + 1)))
        none = ell / math.sqrt(ell**2 + 2)
        mx, my = np.isnan(x), np.isnan(y)
        out *= np.where(mx & my, none, np.where(mx | my, one, both))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products over the features that both rows have, scaled up to all features; 0 for rows without one in common."""
    seen = (~np.isnan(a)).astype(float) @ (~np.isnan(b)).astype(float).T
    return np.where(seen > 0, np.nan_to_num(a) @ np.nan_to_num(b).T * a.shape[1] / np.maximum(seen, 1), 0.0)


@dataclass
class Shape:
    """Which kernel: rbf over ``lengths``, linear, or poly ``(gamma <a, b> + coef0) ** degree``."""

    kind: str
    lengths: np.ndarray
    degree: int = 3
    coef0: float = 0.0

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kind == "rbf":
            return kernel(a, b, self.lengths)
        if self.kind == "linear":
            return products(a, b)
        return (products(a, b) / (2 * self.lengths[0] ** 2) + self.coef0) ** self.degree


@dataclass
class KernelModel:
    """Weights on training rows: prediction = offset + unit * K(x, rows) @ weights."""

    rowwise = True

    features: list[str]
    center: np.ndarray
    scale: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    shape: Shape
    offset: float
    unit: float
    kind: str
    sd: float = 0.0

    def transform(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        """Adds prediction with lo and hi, or decision, probability and prediction for a classifier.

        The half width of an interval grows with the root of features over observed features.
        """
        names = {"regressor": ["prediction", "lo", "hi"], "classifier": ["decision", "probability", "prediction"]}[self.kind]
        own = [c for c in df.columns if c not in names]
        schema = T.StructType([*(df.schema[c] for c in own), *[T.StructField(c, T.DoubleType()) for c in names]])
        shared, z = df.sparkSession.sparkContext.broadcast(self), normal_quantile(1 - alpha / 2)  # at most MAX_ROWS training rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: KernelModel = shared.value
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in m.features], 1)
                f = m.offset + m.shape((x - m.center) / m.scale, m.rows) @ m.weights * m.unit
                if m.kind == "classifier":
                    p = sigmoid(f)
                    columns = [f, p, (p >= 0.5).astype(float)]
                else:
                    half = z * m.sd * np.sqrt(x.shape[1] / np.maximum((~np.isnan(x)).sum(1), 1))
                    columns = [f, f - half, f + half]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *map(pa.array, columns)], [*own, *names])

        return df.select(*dict.fromkeys([*own, *self.features])).mapInArrow(run, schema)

    def importances(self) -> list[tuple[str, float]]:
        """Shares of the weights' size for a linear kernel, of the features' availability for others."""
        w = np.abs(self.weights @ np.nan_to_num(self.rows)) if self.shape.kind == "linear" else 1 - np.isnan(self.rows).mean(0)
        return [(c, float(v / w.sum()) if w.sum() else 1 / len(w)) for c, v in zip(self.features, w, strict=True)]


def _lengths(x: np.ndarray, gamma) -> np.ndarray:
    """Lengths that stand for gamma: 'scale' is 1 / (p var), 'auto' is 1 / p, or a number."""
    if gamma == "scale":
        spread = max(float(np.nanvar(x, axis=0).sum() + np.isnan(x).mean(0).sum()), 1e-12)
        gamma = 1 / spread
    elif gamma == "auto":
        gamma = 1 / x.shape[1]
    else:
        check_positive_float(gamma, "gamma", "support")
    return np.full(x.shape[1], math.sqrt(1 / (2 * gamma)))


def fit_support(df: DataFrame, features: list[str], label: str, task: str = "classifier", c: float = 1.0, epsilon: float = 0.1, kind: str = "rbf", gamma="scale", degree: int = 3, coef0: float = 0.0, sweeps: int = 60) -> KernelModel:
    """Support vector machine on the expected kernel by dual coordinate descent; the offset is a constant kernel.

    task is classifier (labels 0/1, calibrated by Platt's logistic) or regressor.
    """
    check_choice(task, ("classifier", "regressor"), "task", "support")
    check_choice(kind, ("rbf", "linear", "poly"), "kind", "support")
    check_positive_float(c, "c", "support")
    x, y, center, scale = _training(df, features, label)
    shape = Shape(kind, _lengths(x, gamma), degree, coef0)
    k = shape(x, x)
    if kind == "rbf":
        np.fill_diagonal(k, 1.0)
    k = k + 1.0
    if task == "classifier":
        s = 2 * y - 1
        a, f = np.zeros(len(y)), np.zeros(len(y))
        for _ in range(sweeps):
            for i in range(len(y)):
                new = min(max(a[i] + (1 - s[i] * f[i]) / max(k[i, i], 1e-12), 0.0), c)
                if new != a[i]:
                    f += (new - a[i]) * s[i] * k[i]
                    a[i] = new
        w = a * s

        def platt(theta: np.ndarray) -> tuple[float, np.ndarray]:
            p = np.clip(sigmoid(theta[0] + theta[1] * f), 1e-12, 1 - 1e-12)
            return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 1e-3 * theta @ theta, -np.array([(y - p).sum(), ((y - p) * f).sum()]) + 2e-3 * theta

        theta, _ = lbfgs(platt, np.array([0.0, 1.0]), 100, 1e-6)
        return KernelModel(features, center, scale, x, w * theta[1], shape, float(theta[0] + theta[1] * w.sum()), 1.0, "classifier")
    my, sy = y.mean(), y.std() or 1.0
    t = (y - my) / sy
    b, f = np.zeros(len(t)), np.zeros(len(t))
    for _ in range(sweeps):
        for i in range(len(t)):
            g = t[i] - f[i] + k[i, i] * b[i]
            new = np.sign(g) * max(abs(g) - epsilon, 0.0) / max(k[i, i], 1e-12)
            new = min(max(new, -c), c)
            if new != b[i]:
                f += (new - b[i]) * k[i]
                b[i] = new
    return KernelModel(features, center, scale, x, b, shape, float(my + sy * b.sum()), float(sy), "regressor", float(sy * np.std(t - f)))
