"""Gaussian processes for bounded tables: regression and Laplace classification.

Kernels are products over the features; a missing coordinate is integrated over
its standard normal distribution by quadrature.  Equal rows of a classification
are one row with a count, without loss.  A regression refuses more than
``kernels.MAX_ROWS`` labelled rows.  A classification refuses none: its fit
takes about five matrices of the distinct rows on the driver, and the cube of
their number in time.  Predictions run over any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lacuna.functions.checks import check_choice, check_positive_int
from lacuna.functions.numerics import gauss_hermite, inverse_lower, lbfgs, normal_quantile, safe_cholesky, sigmoid, solve_lower, solve_upper
from lacuna.operators.kernels import _distinct, _training

KERNELS = ("rbf", "matern52", "matern12")
#: Rows whose kernel with all others is worked out at a time.
TILE = 256


def shape(r: np.ndarray, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """The kernel at scaled distances and its derivative by the log length."""
    if kernel == "rbf":
        k = np.exp(-0.5 * r * r)
        return k, r * r * k
    if kernel == "matern52":
        a = math.sqrt(5) * np.abs(r)
        e = np.exp(-a)
        return (1 + a + a * a / 3) * e, a * a * (1 + a) / 3 * e
    a = np.abs(r)
    e = np.exp(-a)
    return e, a * e


def coordinate(x: np.ndarray, y: np.ndarray, length: float, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """One feature's factor for all pairs, and its derivative by the log length."""
    t, w = gauss_hermite(20)
    mx, my = np.isnan(x)[:, None], np.isnan(y)[None]

    def against_nodes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, d = shape((np.nan_to_num(z)[:, None] - t[None]) / length, kernel)
        return k @ w, d @ w

    both = shape((np.nan_to_num(x)[:, None] - np.nan_to_num(y)[None]) / length, kernel)
    left, right = against_nodes(x), against_nodes(y)
    none = shape((t[:, None] - t[None]) / length, kernel)
    out = []
    for i in (0, 1):
        one = np.where(my, left[i][:, None], right[i][None])
        out.append(np.where(mx & my, w @ none[i] @ w, np.where(mx | my, one, both[i])))
    return out[0], out[1]


def correlation(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, kernel: str, same: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """The product kernel of all pairs and its derivatives by the log lengths; a row equals itself where both tables are the same."""
    parts = [coordinate(a[:, j], b[:, j], ell, kernel) for j, ell in enumerate(lengths)]
    k = np.prod([p[0] for p in parts], axis=0)
    slopes = [k / np.maximum(p[0], 1e-300) * p[1] for p in parts]
    if same:
        np.fill_diagonal(k, 1.0)
        for s in slopes:
            np.fill_diagonal(s, 0.0)
    return k, slopes


@dataclass
class ProcessModel:
    """Training rows and the weights that predictions need."""

    rowwise = True

    features: list[str]
    center: np.ndarray
    scale: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    amplitude: float
    noise: float
    kernel: str
    weights: np.ndarray
    chol: np.ndarray
    root: np.ndarray
    offset: float
    unit: float
    task: str
    value: float
    ard: bool

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the latent function at raw feature rows."""
        k = self.amplitude * correlation((x - self.center) / self.scale, self.rows, self.lengths, self.kernel)[0]
        v = solve_lower(self.chol, self.root[:, None] * k.T)
        return k @ self.weights, np.maximum(self.amplitude - np.square(v).sum(0), 0.0)

    def transform(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        """Regression: prediction, sd, lo, hi; classification: decision, probability, prediction."""
        names = ["prediction", "sd", "lo", "hi"] if self.task == "regression" else ["decision", "probability", "prediction"]
        own = [c for c in df.columns if c not in names]
        schema = T.StructType([*(df.schema[c] for c in own), *[T.StructField(c, T.DoubleType()) for c in names]])
        shared, z = df.sparkSession.sparkContext.broadcast(self), normal_quantile(1 - alpha / 2)  # the training rows and the square of their number

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: ProcessModel = shared.value
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in m.features], 1)
                parts = [m.posterior(x[i : i + TILE]) for i in range(0, max(1, len(x)), TILE)]
                f, v = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
                if m.task == "regression":
                    f, sd = m.offset + m.unit * f, m.unit * np.sqrt(v + m.noise)
                    columns = [f, sd, f - z * sd, f + z * sd]
                else:
                    p = sigmoid(f / np.sqrt(1 + math.pi * v / 8))
                    columns = [f, p, (p >= 0.5).astype(float)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *map(pa.array, columns)], [*own, *names])

        return df.select(*dict.fromkeys([*own, *self.features])).mapInArrow(run, schema)

    def importances(self) -> list[tuple[str, float]]:
        """Shares of 1 / length with one length per feature, else of the features' availability."""
        w = 1 / self.lengths if self.ard else 1 - np.isnan(self.rows).mean(0)
        return [(c, float(v / w.sum()) if w.sum() else 1 / len(w)) for c, v in zip(self.features, w, strict=True)]


def _search(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, restarts: int, steps: int) -> tuple[np.ndarray, float]:
    """The best of several runs from the start and from fixed random points around it."""
    rng = np.random.default_rng(0)
    best = None
    for turn in range(1 + restarts):
        theta, value = lbfgs(objective, start if not turn else start + rng.normal(0, 1, len(start)), steps, 1e-4)
        if best is None or value < best[1] - 1e-9:
            best = (theta, value)
    return best


def _lengths(theta: np.ndarray, p: int, ard: bool) -> np.ndarray:
    return np.exp(np.clip(theta[1 : 1 + (p if ard else 1)], -4, 4)) * np.ones(p)


def marginal_likelihood(theta: np.ndarray, x: np.ndarray, t: np.ndarray, kernel: str, ard: bool) -> tuple[float, np.ndarray]:
    """Negative log marginal likelihood and gradient; theta: log amplitude, log lengths, log noise."""
    p = x.shape[1]
    amplitude, noise = math.exp(np.clip(theta[0], -8, 8)), math.exp(np.clip(theta[-1], -10, 4))
    c, slopes = correlation(x, x, _lengths(theta, p, ard), kernel, same=True)
    chol = safe_cholesky(amplitude * c + (noise + 1e-8) * np.eye(len(x)))
    a = np.linalg.solve(chol.T, np.linalg.solve(chol, t))
    half = np.linalg.inv(chol)
    w = half.T @ half - np.outer(a, a)
    lengths = [0.5 * amplitude * (w * s).sum() for s in slopes]
    grad = [0.5 * amplitude * (w * c).sum(), *(lengths if ard else [sum(lengths)]), 0.5 * noise * np.trace(w)]
    return float(0.5 * t @ a + np.log(np.diag(chol)).sum() + 0.5 * len(t) * math.log(2 * math.pi)), np.array(grad)


def repeated(c: np.ndarray, slopes: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(c, slopes, apart, apart's slopes) for distinct rows that stand for ``counts`` equal rows each.

    Equal rows share their latent value but for the part that each has alone
    (``apart``, from its missing cells), so along their common direction, of
    length 1 however many they are, the kernel of all rows is that of the
    distinct ones, scaled by the roots of the counts; along all others it is
    ``apart``.
    """
    w = np.sqrt(counts)
    apart, own = 1 - np.diag(c) + 1e-8, [-np.diag(s) for s in slopes]
    scaled = np.outer(w, w)
    return scaled * c + np.diag(apart), [scaled * s + np.diag(o) for s, o in zip(slopes, own, strict=True)], apart, own


def _tiles(x: np.ndarray, lengths: np.ndarray, kernel: str, ard: bool, counts: np.ndarray) -> Iterator[tuple]:
    """What ``repeated`` gives, for some rows and all at a time: (rows, kernel, slopes, apart, apart's slopes)."""
    w = np.sqrt(counts)
    for i in range(0, len(x), TILE):
        at = slice(i, min(i + TILE, len(x)))
        here = (np.arange(at.stop - i), np.arange(i, at.stop))
        c, slopes = correlation(x[at], x, lengths, kernel)
        apart, scale = 1 - c[here] + 1e-8, np.outer(w[at], w)
        c = scale * c
        c[here] += apart
        out, own = [], []
        for s in slopes if ard else [sum(slopes)]:
            own.append(-s[here])
            s = scale * s
            s[here] += own[-1]
            out.append(s)
        yield at, c, out, apart, own


def _damped(k: np.ndarray, root: np.ndarray) -> np.ndarray:
    out = root[:, None] * k
    out *= root[None]
    out[np.diag_indices(len(out))] += 1
    return out


def laplace_mode(k: np.ndarray, y: np.ndarray, steps: int = 50, tol: float = 1e-8, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(f, a, root, chol, value): the mode of the latent values for labels 0/1 by damped Newton steps.

    With ``counts`` a row stands for so many, ``k`` is the kernel of ``repeated`` and f and a carry the roots of the counts.
    """
    counts = np.ones(len(y)) if counts is None else counts
    w = np.sqrt(counts)
    f, a, value = np.zeros(len(y)), np.zeros(len(y)), -math.inf
    for _ in range(steps):
        p = sigmoid(f / w)
        root = np.sqrt(p * (1 - p))
        chol = None  # its room is needed for the next
        chol = safe_cholesky(_damped(k, root))
        b = root**2 * f + w * (y - p)
        new = b - root * solve_upper(chol, solve_lower(chol, root * (k @ b)))
        size = 1.0
        while True:
            trial = a + size * (new - a)
            g = k @ trial
            reached = float(-0.5 * trial @ g - counts @ np.log1p(np.exp(-np.clip((2 * y - 1) * g / w, -500, 500))))
            if reached >= value or size < 1e-4:
                break
            size /= 2
        done = reached - value < tol
        f, a, value = g, trial, reached
        if done:
            break
    p = sigmoid(f / w)
    root = np.sqrt(p * (1 - p))
    chol = None
    return f, a, root, safe_cholesky(_damped(k, root)), value


def laplace_likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, kernel: str, ard: bool, counts: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Negative approximate log marginal likelihood and gradient; theta: log amplitude, log lengths; a row stands for ``counts`` equal ones."""
    p = x.shape[1]
    counts = np.ones(len(y)) if counts is None else counts
    w = np.sqrt(counts)
    amplitude = math.exp(np.clip(theta[0], -6, 6))
    tiles = lambda: _tiles(x, _lengths(theta, p, ard), kernel, ard, counts)
    k, apart = np.empty((len(x), len(x))), np.empty(len(x))
    for at, c, _, alone, _ in tiles():
        k[at], apart[at] = amplitude * c, alone
    f, a, root, chol, value = laplace_mode(k, y, counts=counts)
    pi = sigmoid(f / w)
    half = inverse_lower(chol)
    third = -pi * (1 - pi) * (1 - 2 * pi)
    # the directions among equal rows, counts - 1 of them: their part of the determinant, and its share by the kernel
    among = 1 + root**2 * amplitude * apart
    share = (counts - 1) / among
    turns = 1 + (p if ard else 1)
    inner, quad, trace, alone_of, b_of = np.empty(len(x)), np.zeros(turns), np.zeros(turns), np.empty((turns, len(x))), np.empty((turns, len(x)))
    for at, _, slopes, _, own in tiles():
        inner[at] = np.square(half @ (root[:, None] * k[at].T)).sum(0)
        whole = root[at, None] * (half[at.start :, at].T @ half[at.start :]) * root
        for j, (d, e) in enumerate([(k[at], amplitude * apart[at]), *((amplitude * s, amplitude * o) for s, o in zip(slopes, own, strict=True))]):
            quad[j] += a[at] @ (d @ a)
            trace[j] += (whole * d).sum()
            alone_of[j, at], b_of[j, at] = e, d @ (w * (y - pi))
    moved = 0.5 * (np.diag(k) - inner + share * amplitude * apart) * third / w  # how the determinant's terms follow the mode
    grad = []
    for j, b in enumerate(b_of):
        follows = b - k @ (root * solve_upper(chol, solve_lower(chol, root * b)))
        grad.append(-(0.5 * quad[j] - 0.5 * trace[j] - 0.5 * (share * root**2) @ alone_of[j] + moved @ follows))
    return float(-(value - np.log(np.diag(chol)).sum() - 0.5 * (counts - 1) @ np.log(among))), np.array(grad)


def fit(df: DataFrame, features: list[str], label: str, task: str = "regression", kernel: str = "rbf", ard: bool = False, restarts: int = 1, steps: int = 40) -> ProcessModel:
    """Hyperparameters by (approximate) marginal likelihood; labels are numbers, or 0/1 for classification."""
    check_choice(kernel, KERNELS, "kernel", "process")
    check_choice(task, ("regression", "classification"), "task", "process")
    check_positive_int(restarts, "restarts", "process", 0)
    p = len(features)
    width = 1 + (p if ard else 1)
    if task == "classification":
        x, y, counts, center, scale = _distinct(df, features, label)
        if set(np.unique(y)) - {0.0, 1.0}:
            raise ValueError("process: classification takes labels 0 and 1")
        theta, value = _search(lambda t: laplace_likelihood(t, x, y, kernel, ard, counts), np.zeros(width), restarts, steps)
        amplitude, lengths = math.exp(np.clip(theta[0], -6, 6)), _lengths(theta, p, ard)
        k = np.empty((len(x), len(x)))
        for at, c, *_ in _tiles(x, lengths, kernel, ard, counts):
            k[at] = amplitude * c
        f, _, root, chol, _ = laplace_mode(k, y, counts=counts)
        w = np.sqrt(counts)
        return ProcessModel(features, center, scale, x, lengths, amplitude, 0.0, kernel, counts * (y - sigmoid(f / w)), chol, w * root, 0.0, 1.0, task, -value, ard)
    x, y, center, scale = _training(df, features, label)
    offset, unit = float(y.mean()), float(y.std()) or 1.0
    t = (y - offset) / unit
    theta, value = _search(lambda v: marginal_likelihood(v, x, t, kernel, ard), np.concatenate([np.zeros(width), [-2.0]]), restarts, steps)
    amplitude, noise, lengths = math.exp(np.clip(theta[0], -8, 8)), math.exp(np.clip(theta[-1], -10, 4)), _lengths(theta, p, ard)
    chol = safe_cholesky(amplitude * correlation(x, x, lengths, kernel, same=True)[0] + (noise + 1e-8) * np.eye(len(x)))
    weights = np.linalg.solve(chol.T, np.linalg.solve(chol, t))
    return ProcessModel(features, center, scale, x, lengths, amplitude, noise, kernel, weights, chol, np.ones(len(x)), offset, unit, task, -value, ard)
