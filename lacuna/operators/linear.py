"""Gaussian regressions with missing features and labels, fitted on pattern blocks.

The data are scanned for a profile and once for the blocks; EM, the penalised
likelihoods and their standard errors are driver algebra.  Predictions are one
CASE expression over the patterns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import exprs
from lacuna.functions.numerics import hessian, lbfgs, normal_quantile, standard_errors, two_sided_p
from lacuna.plans import gaussian
from lacuna.plans.patterns import Patterns, collect, collect_weighted, degenerate, profile


@dataclass
class LinearModel:
    """A fitted linear model with the moments of its features (raw scale)."""

    rowwise = True

    features: list[str]
    intercept: float
    coef: np.ndarray
    sigma2: float
    mu: np.ndarray
    sigma: np.ndarray
    se: list[float | None] = field(default_factory=list)
    loglik: float = math.nan
    n: float = 0.0
    n_parameters: int = 0

    @property
    def aic(self) -> float:
        return 2 * self.n_parameters - 2 * self.loglik

    @property
    def bic(self) -> float:
        return self.n_parameters * math.log(max(self.n, 1)) - 2 * self.loglik

    def _mean(self, obs: list[int], mis: list[int]) -> tuple[float, np.ndarray]:
        k, shift, _ = gaussian.conditional(self.mu, self.sigma, np.array(obs, int), np.array(mis, int))
        w = self.coef[obs] + (self.coef[mis] @ k if mis else 0)
        return float(self.intercept + (self.coef[mis] @ shift if mis else 0)), w

    def _sd(self, obs: list[int], mis: list[int]) -> tuple[float, np.ndarray]:
        c = gaussian.conditional(self.mu, self.sigma, np.array(obs, int), np.array(mis, int))[2]
        return math.sqrt(self.sigma2 + (float(self.coef[mis] @ c @ self.coef[mis]) if mis else 0.0)), np.zeros(len(obs))

    def transform(self, df: DataFrame, alpha: float = 0.05) -> DataFrame:
        """Adds prediction, lo and hi: E[y | what is observed] and its interval."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"features not in the table: {', '.join(missing)}")
        masks = [r["m"] for r in df.select(exprs.mask(self.features).alias("m")).distinct().collect()]
        z = normal_quantile(1 - alpha / 2)
        sd = gaussian.affine(self.features, masks, self._sd)
        out = df.withColumn("prediction", gaussian.affine(self.features, masks, self._mean))
        return out.withColumns({"lo": F.col("prediction") - z * sd, "hi": F.col("prediction") + z * sd})

    def coefficients(self, spark) -> DataFrame:
        """(feature, coef, se, z, p_value)."""
        rows = []
        for name, b, s in zip(["intercept", *self.features], [self.intercept, *self.coef], self.se or [None] * (len(self.coef) + 1), strict=True):
            s = None if s is None else float(s)
            z = float(b) / s if s else None
            rows.append((name, float(b), s, z, two_sided_p(z) if z is not None else None))
        return spark.createDataFrame(rows, "feature string, coef double, se double, z double, p_value double")


def _expand(features: list[str], keep: list[str], prof: dict, values: np.ndarray, fill: float = 0.0) -> np.ndarray:
    return np.array([values[keep.index(c)] if c in keep else fill for c in features])


def label_blocks(p: Patterns, mu: np.ndarray, sigma: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per pattern with the label (last column) observed: n, cross products of (1, filled features, y), conditional covariance."""
    width = len(mu)
    out = []
    for b in p.blocks.values():
        if not len(b.obs) or b.obs[-1] != width:
            continue
        obs = b.obs[:-1]
        mis = np.setdiff1d(np.arange(width), obs)
        k, shift, c = gaussian.conditional(mu, sigma, obs, mis)
        lin = np.zeros((width + 2, len(b.obs) + 1))
        lin[0, 0] = 1
        lin[1 + obs, 1 + np.arange(len(obs))] = 1
        lin[1 + mis, 0] = shift
        lin[np.ix_(1 + mis, 1 + np.arange(len(obs)))] = k
        lin[-1, -1] = 1
        q = np.block([[np.array([[b.n]]), b.s[None]], [b.s[:, None], b.q]])
        cov = np.zeros((width, width))
        cov[np.ix_(mis, mis)] = c
        out.append((b.n, lin @ q @ lin.T, cov))
    return out


#: Least log sigma of a fit, on the standardised scale: where features give the label exactly the likelihood has no maximum, and this is its end.
LEAST = -14.0


def objective(blocks: list[tuple[float, np.ndarray, np.ndarray]], theta: np.ndarray, l2: float = 0.0) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of y given the features, theta = (intercept, coefficients, log sigma), with its gradient."""
    beta, s2 = theta[1:-1], math.exp(2 * min(max(float(theta[-1]), LEAST), 100.0))
    value = 0.5 * l2 * beta @ beta
    grad = np.zeros_like(theta)
    grad[1:-1] = l2 * beta
    u = np.concatenate([-theta[:-1], [1.0]])
    for n, q, c in blocks:
        v = s2 + beta @ c @ beta
        rss = u @ q @ u
        value += 0.5 * n * (math.log(2 * math.pi) + math.log(v)) + 0.5 * rss / v
        w = 0.5 * n / v - 0.5 * rss / v**2
        grad[:-1] -= (q @ u)[:-1] / v
        grad[1:-1] += 2 * w * (c @ beta)
        grad[-1] += 2 * s2 * w
    return value, grad


def curvature(blocks: list[tuple[float, np.ndarray, np.ndarray]], theta: np.ndarray, l2: float = 0.0) -> np.ndarray:
    """Second derivatives of ``objective``."""
    beta, s2 = theta[1:-1], math.exp(2 * min(max(float(theta[-1]), LEAST), 100.0))
    out = np.diag(np.concatenate([[0.0], np.full(len(beta), l2), [0.0]]))
    u = np.concatenate([-theta[:-1], [1.0]])
    for n, q, c in blocks:
        v = s2 + beta @ c @ beta
        rss = u @ q @ u
        w, slope = 0.5 * n / v - 0.5 * rss / v**2, rss / v**3 - 0.5 * n / v**2
        of_v = np.concatenate([[0.0], 2 * c @ beta, [2 * s2]])
        of_rss = np.concatenate([-2 * (q @ u)[:-1], [0.0]])
        cross = np.outer(of_rss, of_v) / (2 * v**2)
        out += slope * np.outer(of_v, of_v) - cross - cross.T
        out[:-1, :-1] += q[:-1, :-1] / v
        out[1:-1, 1:-1] += 2 * w * c
        out[-1, -1] += 4 * s2 * w
    return out


def _sharpened(blocks: list[tuple[float, np.ndarray, np.ndarray]], theta: np.ndarray, l2: float, steps: int = 60) -> np.ndarray:
    """Newton steps from where the search ended, while the value falls or, as that of many rows has no digits left, the gradient does.

    Steps that raise the value are halved and log sigma stays at or above
    ``LEAST``, so that a label without noise ends there in place of running away.
    """
    value, grad = objective(blocks, theta, l2)
    for _ in range(steps):
        h = curvature(blocks, theta, l2)
        on = np.arange(len(theta) - (theta[-1] <= LEAST and grad[-1] > 0))
        unit = 1 / np.sqrt(np.maximum(np.abs(np.diag(h)[on]), 1e-300))
        if not np.isfinite(h).all():
            break
        low, vectors = np.linalg.eigh(unit[:, None] * h[np.ix_(on, on)] * unit)
        move = np.zeros_like(theta)
        move[on] = -unit * (vectors @ (vectors.T @ (unit * grad[on]) / np.maximum(np.abs(low), 1e-12)))
        move *= min(1.0, 2 / max(abs(float(move[-1])), 1e-300))
        noise, taken = 1e-12 * (1 + abs(value)), False
        for _ in range(30):
            trial = theta + move
            trial[-1] = max(trial[-1], LEAST)
            new, new_grad = objective(blocks, trial, l2)
            if np.isfinite(new) and np.isfinite(new_grad).all() and new <= value + noise:
                taken = new < value - noise or np.abs(unit * new_grad[on]).max() < np.abs(unit * grad[on]).max()
                break
            move = move / 2
        if not taken:
            break
        theta, value, grad = trial, new, new_grad
    return theta


def fit(df: DataFrame, features: list[str], label: str, l2: float = 0.0, l1: float = 0.0, compute_se: bool = True, patterns: Patterns | None = None) -> LinearModel:
    """Full-information fit: moments of (features, label) by EM, then the (penalised) likelihood of the label.

    Penalties act on standardised coefficients and are not divided by n; l1 is
    solved over positive and negative parts.  Rows without label inform the
    features' moments.  Columns without spread get coefficient 0.  Unpenalised
    fits with no more rows than parameters are refused.
    """
    if label in features:
        raise ValueError("the label is among the features")
    prof = profile(df, [*features, label])
    if not prof[label]["n"]:
        raise ValueError(f"no observed value in {label}")
    empty = [c for c in features if not prof[c]["n"]]
    if empty:
        raise ValueError(f"no observed value in {', '.join(empty)}")
    keep = [c for c in features if not degenerate(prof[c])]
    width = len(keep)
    if not l1 and not l2 and prof[label]["n"] <= width + 1:
        raise ValueError(f"{prof[label]['n']} labelled rows cannot identify {width + 1} parameters; use a penalty")
    p = patterns or collect(df, [*keep, label], prof=prof)
    m = gaussian.em(p, 500, 1e-10, 1e-8 if not (l1 or l2) else 1e-6, settle=not (l1 or l2))
    mu, sigma = m.mu[:-1], m.sigma[:-1, :-1]
    blocks = label_blocks(p, mu, sigma)
    start = np.zeros(width + 2)
    if width:
        start[1:-1] = np.linalg.lstsq(sigma + 1e-9 * np.eye(width), m.sigma[:-1, -1], rcond=None)[0]
    start[0] = m.mu[-1] - start[1:-1] @ mu
    start[-1] = 0.5 * math.log(max(1e-12, m.sigma[-1, -1] - start[1:-1] @ m.sigma[:-1, -1]))
    if l1:
        def split(t: np.ndarray) -> tuple[float, np.ndarray]:
            u, v = t[1 : width + 1], t[width + 1 : -1]
            value, g = objective(blocks, np.concatenate([t[:1], u - v, t[-1:]]), l2)
            return value + l1 * (u.sum() + v.sum()), np.concatenate([g[:1], g[1:-1] + l1, l1 - g[1:-1], g[-1:]])

        b = start[1:-1]
        t0 = np.concatenate([start[:1], np.maximum(b, 0), np.maximum(-b, 0), start[-1:]])
        lower = np.concatenate([[-np.inf], np.zeros(2 * width), [LEAST]])
        t, _ = lbfgs(split, t0, 500, 1e-7, lower=lower)
        theta = np.concatenate([t[:1], t[1 : width + 1] - t[width + 1 : -1], t[-1:]])
    else:
        theta, _ = lbfgs(lambda t: objective(blocks, t, l2), start, 300, 1e-8, lower=np.append(np.full(width + 1, -np.inf), LEAST))
        theta = _sharpened(blocks, theta, l2)
    se: list[float | None] = [None] * (width + 2)
    if compute_se:
        # with a lasso: the coefficients that are not 0 move as the smooth part has it, where the penalty is linear; the others do not move
        active = np.array([True, *(np.abs(theta[1:-1]) > 1e-9), True]) if l1 else np.ones(width + 2, bool)
        inverse = np.zeros((width + 2, width + 2))
        inverse[np.ix_(active, active)] = np.linalg.pinv(hessian(lambda t: objective(blocks, t, l2)[0], theta)[np.ix_(active, active)])
        se = standard_errors(inverse)
    sy, sx = p.scale[-1], p.scale[:-1]
    coef = theta[1:-1] * sy / sx
    intercept = p.center[-1] + sy * theta[0] - coef @ p.center[:-1]
    raw_mu, raw_sigma = gaussian.raw_moments(p, m)
    wide = np.zeros((len(features), len(features)))
    on = [features.index(c) for c in keep]
    wide[np.ix_(on, on)] = raw_sigma[:-1, :-1]
    means = np.array([raw_mu[keep.index(c)] if c in keep else prof[c]["mean"] for c in features])
    errors: list[float | None] = [None]
    if se[0] is not None and all(s is not None for s, on in zip(se[1:-1], theta[1:-1], strict=True) if on):
        errors = [sy * math.sqrt(se[0] ** 2 + sum((p.center[j] * (se[j + 1] or 0.0) / sx[j]) ** 2 for j in range(width)))]
    errors += [None if c not in keep or se[keep.index(c) + 1] is None else se[keep.index(c) + 1] * sy / sx[keep.index(c)] for c in features]
    labelled = sum(b[0] for b in blocks)
    loglik = -objective(blocks, theta)[0] - labelled * math.log(sy)
    count = (width + 2) + width + width * (width + 1) // 2
    return LinearModel(features, float(intercept), _expand(features, keep, prof, coef), float(math.exp(2 * theta[-1]) * sy**2), means, wide, errors, loglik, labelled, count)


def cv_ridge(df: DataFrame, key: str, features: list[str], label: str, alphas: list[float], k: int = 5) -> DataFrame:
    """(alpha, rss, r2): ridge strengths by cross-validation from one scan.

    The blocks are collected per fold; a training set's are the sum of the other
    folds' and the held-out error is a quadratic form in its own.
    """
    rows = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(k)).cast("int"))
    prof = profile(df, [*features, label])
    folds = collect(rows, [*features, label], by=("_fold",), prof=prof)
    parts = []
    for fold, held in folds.items():
        train = None
        for other, p in folds.items():
            if other != fold:
                train = p if train is None else train.merge(p)
        m = gaussian.em(train, 200, 1e-8, 1e-6)
        parts.append((label_blocks(train, m.mu[:-1], m.sigma[:-1, :-1]), label_blocks(held, m.mu[:-1], m.sigma[:-1, :-1])))
    q = sum(q for _, held in parts for _, q, _ in held)
    n = sum(n for _, held in parts for n, _, _ in held)
    var = q[-1, -1] - q[0, -1] ** 2 / n
    out = []
    for alpha in alphas:
        rss = 0.0
        for train, held in parts:
            theta, _ = lbfgs(lambda t, b=train: objective(b, t, alpha), np.zeros(len(features) + 2), 300, 1e-7)
            u = np.concatenate([-theta[:-1], [1.0]])
            rss += sum(u @ q @ u for _, q, _ in held)
        out.append((float(alpha), float(rss), float(1 - rss / var)))
    return df.sparkSession.createDataFrame(out, "alpha double, rss double, r2 double")


def conditional_mean_imputation(df: DataFrame, columns: list[str], tol: float = 1e-6, reg: float = 1e-6) -> DataFrame:
    """``df`` with every missing cell of ``columns`` replaced by its mean given the row's observed cells."""
    p, m = gaussian.moments(df, columns, 2000, tol, reg)
    mu, sigma = gaussian.raw_moments(p, m)
    masks = sorted(p.blocks) if isinstance(p, Patterns) else [r["m"] for r in df.select(exprs.mask(columns).alias("m")).distinct().collect()]
    return df.withColumns({c: gaussian.conditional_mean(columns, mu, sigma, j, masks) for j, c in enumerate(columns)})


def poisson_draws(member: int, key: str, seed: int = 0) -> Column:
    """How often a member's bootstrap takes a row: Poisson(1), a fixed function of (seed, member, key): no shuffle, no driver list, the same after a lost executor."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(member), key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    times, total, term = F.lit(0), 0.0, math.exp(-1.0)
    for k in range(8):
        total += term
        times = times + (u > total).cast("int")
        term /= k + 1
    return times


def multiple_imputation(df: DataFrame, columns: list[str], key: str, m: int = 5, seed: int = 0, posterior: bool = False, label: str | None = None) -> DataFrame:
    """``m`` completed copies of ``df`` (column ``imputation``): conditional means plus conditional normal noise.

    With ``label`` the outcome is one more variable of the joint distribution and
    is completed too.  With ``posterior`` every copy has moments of its own, those
    of a Poisson bootstrap of the rows (all bootstraps are summed in one scan), so
    that the copies differ by what the moments are uncertain by.  The noise and
    the bootstraps are fixed functions of (seed, imputation, key, column), so
    reruns and lost executors give the same draws.
    """
    columns = [*columns, label] if label else list(columns)
    if posterior:
        parts = collect_weighted(df, columns, [poisson_draws(i, key, seed + 1_000_003) for i in range(1, m + 1)])
        moments = [gaussian.raw_moments(p, gaussian.em(p, 200, 1e-6, 1e-6)) for p in parts]
    else:
        moments = [gaussian.raw_moments(*gaussian.moments(df, columns, 200, 1e-6, 1e-6))] * m
    width = len(columns)
    own = [c for c in df.columns if c.lower() != "imputation"]

    def unit(j: int) -> Column:
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * j + i), "imputation", key), F.lit(1 << 40)) + 0.5) / float(1 << 40) for i in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])

    copies = df.select(*own).withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(m))))
    rows = copies.select("imputation", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.array(*[unit(j) for j in range(width)]).alias("z"), F.struct(*own).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            x, z = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) for k in (1, 2))
            x = x.copy()
            number, gone = batch.column(0).to_numpy(), np.isnan(x)
            kind = np.unique(np.concatenate([np.packbits(gone, axis=1), number.astype("<i4").view(np.uint8).reshape(-1, 4)], 1), axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(kind, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
                if not len(at) or not gone[at[0]].any():
                    continue
                name = (int(number[at[0]]), gone[at[0]].tobytes())
                if name not in known:
                    mu, sigma = moments[name[0] - 1]
                    obs, mis = np.flatnonzero(~gone[at[0]]), np.flatnonzero(gone[at[0]])
                    k, shift, c = gaussian.conditional(mu, sigma, obs, mis)
                    low, vectors = np.linalg.eigh(c)
                    known[name] = obs, mis, k, shift, vectors @ np.diag(np.sqrt(np.maximum(low, 0))) @ vectors.T
                obs, mis, k, shift, root = known[name]
                # row by row sums, the same whatever rows come together
                x[np.ix_(at, mis)] = shift + np.einsum("ij,kj->ik", x[np.ix_(at, obs)], k) + np.einsum("ij,kj->ik", z[np.ix_(at, mis)], root)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(3)], names=["imputation", "x", "row"])

    done = rows.mapInArrow(run, T.StructType([rows.schema["imputation"], T.StructField("x", T.ArrayType(T.DoubleType())), rows.schema["row"]]))
    place = {c: j for j, c in enumerate(columns)}
    return done.select(*[F.col("x")[place[c]].alias(c) if c in place else F.col("row")[c].alias(c) for c in own], "imputation")
