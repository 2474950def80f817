"""Logistic regression with missing features, many fits in one pass.

A row enters through its expected features given what is observed and, per
pattern, the covariance that the missing ones keep; the logit's uncertainty is
integrated out.  The labelled rows are packed once into blocks of one pattern.
One job then evaluates likelihood, gradient and information for a whole matrix of
parameter vectors, each with its own moments, penalties and rows (all but a fold),
so that a path of penalties over k folds takes no more jobs than one fit: a
proximal Newton iteration that all fits go through together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import exprs
from lacuna.functions.numerics import gauss_hermite, sigmoid, standard_errors
from lacuna.plans import gaussian
from lacuna.plans.patterns import collect, degenerate, profile


def newton_sums(df: DataFrame, features: list[str], label: str, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, gradient, information) of a complete-data logistic model, all in column expressions."""
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    a = F.lit(float(beta[0]))
    for c, w in zip(features, beta[1:], strict=True):
        a = a + F.lit(float(w)) * F.col(c)
    p = exprs.sigmoid(F.col("_a"))
    k = len(x)
    aggs = [F.sum(F.col(label) * exprs.log_sigmoid(F.col("_a")) + (1 - F.col(label)) * exprs.log_sigmoid(-F.col("_a"))).alias("l")]
    aggs += [F.sum(x[i] * (F.col(label) - p)).alias(f"g{i}") for i in range(k)]
    aggs += [F.sum(x[i] * x[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.withColumn("_a", a).agg(*aggs).first()
    h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return row["l"], np.array([row[f"g{i}"] for i in range(k)]), h


@dataclass
class LogisticModel:
    """Coefficients on the data's scale with their standard errors, and the moments that predictions need."""

    rowwise = True

    features: list[str]
    intercept: float
    coef: np.ndarray
    se: list[float | None]
    loglik: float
    mu: np.ndarray
    sigma: np.ndarray

    def _logit(self, obs: list[int], mis: list[int]) -> tuple[float, np.ndarray]:
        k, shift, _ = gaussian.conditional(self.mu, self.sigma, np.array(obs, int), np.array(mis, int))
        w = self.coef[obs] + (self.coef[mis] @ k if mis else 0)
        return float(self.intercept + (self.coef[mis] @ shift if mis else 0)), w

    def _variance(self, obs: list[int], mis: list[int]) -> tuple[float, np.ndarray]:
        _, _, c = gaussian.conditional(self.mu, self.sigma, np.array(obs, int), np.array(mis, int))
        return (float(self.coef[mis] @ c @ self.coef[mis]) if mis else 0.0), np.zeros(len(obs))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds decision (plug-in logit), probability (logit uncertainty integrated out) and prediction.

        The integral is a sum over fixed nodes inside the JVM; only where a
        pattern leaves a variance above 1 the wide rule runs in Arrow batches.
        """
        masks = [r["m"] for r in df.select(exprs.mask(self.features).alias("m")).distinct().collect()]
        logit, variance = (gaussian.affine(self.features, masks, f) for f in (self._logit, self._variance))
        out = df.withColumn("decision", logit).withColumn("_variance", variance)
        wide = any(self._variance([j for j, c in enumerate(m) if c == "0"], [j for j, c in enumerate(m) if c == "1"])[0] > 1 for m in masks)
        p = exprs.wide_logistic_normal(F.col("decision"), F.col("_variance")) if wide else exprs.logistic_normal(F.col("decision"), F.col("_variance"))
        out = out.withColumn("probability", p).drop("_variance")
        return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


#: Rows of a block; bytes of rows that a task holds before it packs them.
BLOCK_ROWS = 8192
HELD_BYTES = 64 << 20


def distinct(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, z, w) of the distinct rows of all parts, with their weights added."""
    y, z, w = (np.concatenate(v) for v in zip(*parts, strict=True))
    rows = np.column_stack([y, z])
    order = np.lexsort(rows.T)
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[first, 0].copy(), rows[first, 1:].copy(), np.add.reduceat(w[order], first)


def blocks(df: DataFrame, features: list[str], label: str, center: np.ndarray, scale: np.ndarray, fold: Column | None = None) -> DataFrame:
    """(mask, fold, n, y, z, w): the labelled rows, standardised and 0 where missing, packed by pattern and fold (-2 without one).

    Rows of a block that are equal in all of these are one row with their number as weight w.
    """
    rows = df.filter(F.col(label).isNotNull()).select((F.lit(-2) if fold is None else F.coalesce(fold, F.lit(-2))).cast("int").alias("_fold"), F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(features)])
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def packed(key: tuple) -> pa.RecordBatch:
            y, z, w = distinct(held.pop(key))
            return pa.RecordBatch.from_pydict({"mask": [key[1]], "fold": pa.array([key[0]], pa.int32()), "n": pa.array([len(y)], pa.int32()), "y": pa.array([y.tobytes()], pa.binary()), "z": pa.array([z.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})

        for batch in batches:
            x = np.stack([batch.column(2 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)], 1) if width else np.zeros((batch.num_rows, 0))
            gone, y, own = np.isnan(x), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            z = np.where(gone, 0.0, (x - center) / scale)
            kind = np.unique(np.concatenate([np.packbits(gone, axis=1), own.astype("<i4").view(np.uint8).reshape(-1, 4)], 1), axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(kind, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
                if len(at):
                    key = (int(own[at[0]]), "".join("01"[int(g)] for g in gone[at[0]]))
                    held.setdefault(key, []).append((y[at], z[at], np.ones(len(at))))
                    size += 8 * len(at) * (2 + width)
                    if sum(len(v) for v, _, _ in held[key]) >= BLOCK_ROWS:
                        size -= sum(8 * len(v) * (2 + width) for v, _, _ in held[key])
                        held[key] = [distinct(held[key])]
                        if len(held[key][0][0]) > BLOCK_ROWS // 2:
                            yield packed(key)
                        else:
                            size += 8 * len(held[key][0][0]) * (2 + width)
            if size > HELD_BYTES:
                yield from [packed(key) for key in list(held)]
                size = 0
        yield from [packed(key) for key in list(held)]

    return rows.mapInArrow(run, "mask string, fold int, n int, y binary, z binary, w binary")


def views(mu: np.ndarray, sigma: np.ndarray, masks: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """How given moments see each pattern: filled features are lin z + shift, and the missing ones keep a covariance."""
    out = {}
    for m in masks:
        obs, mis = (np.array([i for i, c in enumerate(m) if c == v], int) for v in "01")
        lin, shift, cov = np.zeros((len(m), len(m))), np.zeros(len(m)), np.zeros((len(m), len(m)))
        lin[obs, obs] = 1
        if len(mis):
            k, b, c = gaussian.conditional(mu, sigma, obs, mis)
            lin[np.ix_(mis, obs)], shift[mis], cov[np.ix_(mis, mis)] = k, b, c
        out[m] = lin, shift, cov
    return out


def _derivatives(a: np.ndarray, sign: np.ndarray, v: float) -> tuple[np.ndarray, ...]:
    """log E sigmoid(sign (a + t)), t ~ N(0, v), and its derivatives by a, v, aa, av, vv (those by v from the ones by a, as for any smoothing by a normal, but for the first)."""
    nodes, weights = gauss_hermite(20 if v <= 1 else 64) if v > 1e-12 else (np.zeros(1), np.ones(1))
    t = sigmoid(sign[:, None] * (a[:, None] + np.sqrt(max(v, 0.0)) * nodes))
    d1 = t * (1 - t)
    prob = np.clip(t @ weights, 1e-15, 1)
    first = sign * (d1 @ weights) / prob
    second = ((d1 * (1 - 2 * t)) @ weights) / prob
    third = sign * ((d1 * (1 - 6 * t + 6 * t * t)) @ weights) / prob
    fourth = ((d1 * (1 - 2 * t) * (1 - 12 * t + 12 * t * t)) @ weights) / prob
    by_v = ((d1 * (sign[:, None] * nodes)) @ weights) / (2 * np.sqrt(v)) / prob if v > 1e-12 else second / 2
    return np.log(prob), first, by_v, second - first**2, third / 2 - first * by_v, fourth / 4 - by_v**2


def score_many(packed: DataFrame, seen, thetas: np.ndarray, left_out: np.ndarray | None = None, only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihoods, gradients, Hessians) at every row of ``thetas`` (intercept, coefficients): one job.

    seen: a broadcast list with the ``views`` of each parameter vector.  Vector i
    leaves out the rows of fold ``left_out[i]``, or with ``only`` takes them alone.
    """
    count, width = len(thetas), thetas.shape[1] - 1
    size = 1 + (width + 1) + (width + 1) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, size))
        for batch in batches:
            for r in batch.to_pylist():
                y = np.frombuffer(r["y"])
                z = np.frombuffer(r["z"]).reshape(r["n"], width)
                weight = np.frombuffer(r["w"])
                sign = 2 * y - 1
                for i, theta in enumerate(thetas):
                    if left_out is not None and (r["fold"] == left_out[i]) != only:
                        continue
                    lin, shift, cov = seen.value[i][r["mask"]]
                    beta = theta[1:]
                    mb = cov @ beta
                    u = 2 * mb
                    value, a, v, aa, av, vv = (weight * d for d in _derivatives(theta[0] + shift @ beta + z @ (lin.T @ beta), sign, float(beta @ mb)))
                    f = lambda w: lin @ (z.T @ w) + shift * w.sum()  # noqa: B023, E731
                    g = np.concatenate([[a.sum()], f(a) + u * v.sum()])
                    h = np.zeros((width + 1, width + 1))
                    line, cross = f(aa), f(av)
                    middle = lin @ (z.T @ aa)
                    h[0, 0] = aa.sum()
                    h[0, 1:] = line + av.sum() * u
                    h[1:, 0] = h[0, 1:]
                    h[1:, 1:] = lin @ (z.T @ (aa[:, None] * z)) @ lin.T + np.outer(middle, shift) + np.outer(shift, middle) + aa.sum() * np.outer(shift, shift)
                    h[1:, 1:] += np.outer(cross, u) + np.outer(u, cross) + vv.sum() * np.outer(u, u) + 2 * v.sum() * cov
                    total[i] += np.concatenate([[value.sum()], g, h.ravel()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total.size)), "v": total.ravel()})

    got = packed.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("s")).collect()
    total = np.zeros(count * size)
    for r in got:
        total[r["i"]] = r["s"]
    total = total.reshape(count, size)
    return total[:, 0], total[:, 1 : width + 2], total[:, width + 2 :].reshape(count, width + 1, width + 1)


def direction(theta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: float) -> np.ndarray:
    """The step to the least of the quadratic model g, h (of what is minimised) plus the lasso of the coefficients, by coordinate descent where there is one."""
    low, vectors = np.linalg.eigh((h + h.T) / 2)
    h = (vectors * np.maximum(low, 1e-8 * max(1.0, float(np.abs(low).max(initial=0.0))))) @ vectors.T
    if not l1:
        return -np.linalg.solve(h, g)
    at = theta.copy()
    for _ in range(10_000):
        move = 0.0
        for j in range(len(at)):
            b = h[j, j] * at[j] - (g[j] + h[j] @ (at - theta))
            new = b / h[j, j] if not j else np.sign(b) * max(abs(b) - l1, 0.0) / h[j, j]
            move = max(move, abs(new - at[j]))
            at[j] = new
        if move < 1e-12:
            break
    return at - theta


@dataclass
class Path:
    """One of the fits made together: its penalties, the fold it leaves out (-1: none) and what came of it."""

    l2: float
    l1: float = 0.0
    fold: int = -1
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = float("inf")
    hessian: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    steps: int = 0


def solve(packed: DataFrame, seen, paths: list[Path], width: int, steps: int = 60, tol: float = 1e-14, only: bool = False, linear: np.ndarray | None = None) -> int:
    """Fits all paths together by proximal Newton steps with halving; returns the number of jobs.

    With ``only`` a path takes the rows of its fold alone; ``linear`` adds a linear
    function of the parameters to each path's log-likelihood.
    """
    folds = np.array([p.fold for p in paths])
    for p in paths:
        p.theta = np.zeros(width + 1)
    trial = [p.theta for p in paths]
    state: list[tuple | None] = [None] * len(paths)  # gradient, direction, expected decrease, step length
    live = list(range(len(paths)))
    jobs = 0
    while live and jobs < steps:
        part = np.array([folds[i] for i in live])
        own = seen.value
        some = _Some([own[i] for i in live]) if len(live) < len(paths) else None
        values, grads, hessians = score_many(packed, some or seen, np.array([trial[i] for i in live]), part, only)
        jobs += 1
        still = []
        for i, value, g, h in zip(live, values, grads, hessians, strict=True):
            p = paths[i]
            if linear is not None:
                value, g = value + linear[i] @ trial[i], g + linear[i]
            beta = trial[i][1:]
            loss = float(-value + 0.5 * p.l2 * beta @ beta + p.l1 * np.abs(beta).sum())
            g, h = -g, -h
            g[1:] += p.l2 * beta
            h[1:, 1:] += p.l2 * np.eye(width)
            if state[i] is not None:
                d, gain, step = state[i]
                if not loss <= p.loss + 1e-4 * step * gain + 1e-12 * abs(p.loss) and step > 1e-6:
                    state[i] = d, gain, step / 2
                    trial[i] = p.theta + step / 2 * d
                    still.append(i)
                    continue
            p.theta, p.loss, p.hessian, p.steps = trial[i], loss, h, p.steps + 1
            d = direction(p.theta, g, h, p.l1)
            gain = float(g @ d + p.l1 * (np.abs(p.theta[1:] + d[1:]).sum() - np.abs(p.theta[1:]).sum()))
            if -gain > tol * (1 + abs(loss)):
                state[i] = d, gain, 1.0
                trial[i] = p.theta + d
                still.append(i)
        live = still
    return jobs


class _Some:
    """The views of some of the fits, in place of a broadcast of all."""

    def __init__(self, value: list):
        self.value = value


def fit_paths(df: DataFrame, features: list[str], label: str, penalties: list[tuple[float, float]], fold: Column | None = None, folds: int = 0, steps: int = 60, compute_se: bool = False) -> list[tuple[Path, LogisticModel, float | None]]:
    """(path, model, log-likelihood of the rows left out) of every penalty (l2, l1) and, with ``folds``, every fold left out.

    One scan for the blocks of all folds' moments, one that packs the labelled
    rows, and then the jobs of one fit.  A fold's model has seen no row of it but
    for the common scale of the columns.
    """
    prof = profile(df, features)
    keep = [c for c in features if not degenerate(prof[c])]
    width = len(keep)
    if fold is not None and keep:
        parts = {r[0]: p for r, p in collect(df.withColumn("__fold", fold.cast("int")), keep, by=("__fold",), prof=prof).items()}
    else:
        parts = {-1: collect(df, keep, prof=prof)} if keep else {}
    moments, masks = {}, sorted({m for p in parts.values() for m in p.blocks})
    for f in range(folds) if fold is not None else (-1,):
        total = None
        for name, p in sorted(parts.items(), key=lambda x: (x[0] is None, x[0] or 0)):
            if name != f or fold is None:
                total = p if total is None else total.merge(p)
        moments[f] = None if total is None else gaussian.em(total, 100, 1e-5, 1e-6)
    base = next(iter(parts.values()), None)
    center, scale = (base.center, base.scale) if base else (np.zeros(0), np.ones(0))
    masks = masks or [""]
    known = {f: views(m.mu, m.sigma, masks) if m else {"": (np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))} for f, m in moments.items()}
    paths = [Path(float(l2), float(l1), f) for f in moments for l2, l1 in penalties]
    spark = df.sparkSession.sparkContext
    seen = spark.broadcast([known[p.fold] for p in paths])
    packed = blocks(df, keep, label, center, scale, fold).persist()
    out = []
    try:
        solve(packed, seen, paths, width, steps)
        held = score_many(packed, seen, np.array([p.theta for p in paths]), np.array([p.fold for p in paths]), only=True)[0] if fold is not None else [None] * len(paths)
    finally:
        packed.unpersist()
        seen.unpersist()
    at = [keep.index(c) if c in keep else None for c in features]
    on = [j for j, i in enumerate(at) if i is not None]
    for p, other in zip(paths, held, strict=True):
        coef = p.theta[1:] / scale
        wide_mu, wide_sigma = np.array([float(prof[c]["mean"] or 0.0) for c in features]), np.zeros((len(features), len(features)))
        if width:
            m = moments[p.fold]
            wide_mu[on] = center + scale * m.mu
            wide_sigma[np.ix_(on, on)] = m.sigma * np.outer(scale, scale)
        errors: list[float | None] = [None] * (1 + len(features))
        if compute_se:
            active = np.array([True, *(p.theta[1:] != 0)]) if p.l1 else np.ones(width + 1, bool)
            cov = np.zeros((width + 1, width + 1))
            cov[np.ix_(active, active)] = np.linalg.pinv(p.hessian[np.ix_(active, active)])
            se = standard_errors(cov)
            errors = [se[0], *[None if i is None or not active[i + 1] or se[i + 1] is None else se[i + 1] / scale[i] for i in at]]
        model = LogisticModel(features, float(p.theta[0] - coef @ center), np.array([0.0 if i is None else coef[i] for i in at]), errors, -p.loss, wide_mu, wide_sigma)
        out.append((p, model, None if other is None else float(other)))
    return out


def fit(df: DataFrame, features: list[str], label: str, l2: float = 0.01, l1: float = 0.0, steps: int = 60, compute_se: bool = True) -> LogisticModel:
    """Two-stage fit: moments of the features by EM, then the penalised likelihood of the label.

    l2 is the ridge of the standardised coefficients, l1 the lasso.  The label is
    0, 1 or NULL.  Standard errors are those of the information at the fit, with
    a lasso on the coefficients that are not 0 (the others have none).
    """
    return fit_paths(df, features, label, [(l2, l1)], steps=steps, compute_se=compute_se)[0][1]


def cross_validate(df: DataFrame, key: str, features: list[str], label: str, penalties: list[tuple[float, float]], k: int = 5, seed: int = 7) -> DataFrame:
    """(l2, l1, fold, log_loss): the mean negative log-likelihood of each fold under the fits that left it out, from the jobs of one fit."""
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")
    counts = {r[0]: r[1] for r in df.filter(F.col(label).isNotNull()).groupBy(fold).count().collect()}
    rows = [(p.l2, p.l1, p.fold, -v / counts[p.fold] if counts.get(p.fold) else None) for p, _, v in fit_paths(df, features, label, penalties, fold, k)]
    return df.sparkSession.createDataFrame(rows, "l2 double, l1 double, fold int, log_loss double")
