"""Coefficients under outcomes that are not missing at random: all shifts of all imputations are fitted together.

A missing outcome is imputed as if it were missing at random and then shifted.
The copies are completed once, and what a shift changes enters the likelihood
through a few sums, so that no shift needs rows or a scan of its own:

- least squares, with a ridge or lasso: the cross products with the outcome and
  its missing flag are those of every shifted outcome;
- logistic: the outcome enters through the sum of x y alone.  A missing one is
  drawn from its log odds plus the shift, by one uniform number for all shifts,
  so it is 1 beyond a threshold of its own; Newton steps for all cells are one job;
- random intercepts: at a given ratio of variances the likelihood of every shift
  follows from one matrix of an imputation; jobs search the ratios of all cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.checks import check_choice, check_positive_int
from lacuna.operators.linear import multiple_imputation
from lacuna.operators.logistic import Path, blocks, direction, solve, views
from lacuna.plans.patterns import collect, degenerate, profile

FAMILIES = ("linear", "ridge", "lasso", "logistic", "mixed")
#: Ratios of the variances (group to residual) that the search starts from.
RATIOS = np.concatenate([[0.0], np.logspace(-5, 4, 37)])


@dataclass
class Cells:
    """The fits of every imputation and shift: coefficients, the intercept first, and their covariance (NaN where a lasso left one at 0)."""

    features: list[str]
    shifts: np.ndarray
    coef: np.ndarray
    cov: np.ndarray

    def pooled(self) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, standard errors) of each shift by Rubin's rules."""
        within = np.diagonal(self.cov, axis1=2, axis2=3).mean(axis=0)
        m = len(self.coef)
        between = self.coef.var(axis=0, ddof=1) if m > 1 else np.zeros_like(within)
        return self.coef.mean(axis=0), np.sqrt(within + (1 + 1 / m) * between)

    def curve(self, spark, per: float = 1.0) -> DataFrame:
        """(feature, delta_std, coef, se); delta_std are the shifts divided by ``per``."""
        at, se = self.pooled()
        rows = [(c, round(float(s / per), 10), float(at[k, j + 1]), None if np.isnan(se[k, j + 1]) else float(se[k, j + 1])) for j, c in enumerate(self.features) for k, s in enumerate(self.shifts)]
        return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), "feature string, delta_std double, coef double, se double")


def _raw(theta: np.ndarray, cov: np.ndarray, center: np.ndarray, scale: np.ndarray, y: tuple[float, float] = (0.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Standardised coefficients and their covariance on the scale of the data."""
    t = np.diag(np.concatenate([[1.0], 1 / scale]))
    t[0, 1:] = -center / scale
    t *= y[1]
    out = t @ theta
    out[0] += y[0]
    gone = np.isnan(np.diag(cov))
    full = t @ np.where(np.isnan(cov), 0.0, cov) @ t.T
    full[gone], full[:, gone] = np.nan, np.nan
    return out, full


def _covariance(h: np.ndarray, active: np.ndarray) -> np.ndarray:
    cov = np.full(h.shape, np.nan)
    cov[np.ix_(active, active)] = np.linalg.pinv(h[np.ix_(active, active)])
    return cov


def _grams(done: DataFrame, columns: list[str]) -> tuple[list[int], dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """(imputations, cross products of 1 and the standardised columns of each, centers, scales) of the complete rows."""
    parts = {r[0]: p for r, p in collect(done, columns, by=("imputation",)).items()}
    full, grams = "0" * len(columns), {}
    for i, p in parts.items():
        if full in p.blocks:
            b = p.blocks[full]
            grams[i] = np.block([[np.array([[b.n]]), b.s[None]], [b.s[:, None], b.q]])
    if not grams:
        raise ValueError("no complete row to fit")
    any_ = next(iter(parts.values()))
    return sorted(grams), grams, any_.center, any_.scale


def _shifted(width: int, shift: float, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What takes (1, features, outcome, flag) to (1, features, outcome + shift * flag), all standardised."""
    a = np.eye(width + 2, width + 3)
    a[-1, 0] = shift * center[-1] / scale[-2]
    a[-1, -1] = shift * scale[-1] / scale[-2]
    return a


def linear_cells(done: DataFrame, features: list[str], label: str, flag: str, shifts, l2: float = 0.0, l1: float = 0.0) -> Cells:
    """Least squares of every imputation and shift from one aggregation.

    done: completed rows with their ``imputation`` and a flag, 1 where the outcome
    was missing.  The penalties are those of the likelihood with standardised
    features and outcome; a row that still lacks a cell takes no part.
    """
    shifts, width = np.asarray(shifts, float), len(features)
    order, grams, center, scale = _grams(done, [*features, label, flag])
    coef, cov = np.zeros((len(order), len(shifts), width + 1)), np.zeros((len(order), len(shifts), width + 1, width + 1))
    ridge = np.diag([0.0, *[l2] * width])
    for i, name in enumerate(order):
        for k, s in enumerate(shifts):
            a = _shifted(width, s, center, scale)
            g = a @ grams[name] @ a.T
            n, xx, xy, yy = g[0, 0], g[:-1, :-1], g[:-1, -1], g[-1, -1]
            theta, s2 = np.zeros(width + 1), 1.0
            for _ in range(500):
                theta = direction(np.zeros(width + 1), -xy / s2, xx / s2 + ridge, l1)
                new = max((yy - 2 * theta @ xy + theta @ xx @ theta) / n, 1e-14)
                still = abs(new - s2) > 1e-12 * s2 and (l1 or l2)
                s2 = new
                if not still:
                    break
            unbiased = s2 * n / max(1.0, n - width - 1)
            active = np.array([True, *(theta[1:] != 0)]) if l1 else np.ones(width + 1, bool)
            coef[i, k], cov[i, k] = _raw(theta, _covariance(xx / unbiased + ridge, active), center[:width], scale[:width], (center[width], scale[width]))
    return Cells(features, shifts, coef, cov)


def logistic_cells(done: DataFrame, features: list[str], label: str, threshold: str, shifts, l2: float = 0.01, l1: float = 0.0) -> Cells:
    """Logistic fits of every imputation and shift, in the jobs of one fit.

    done: completed rows with their ``imputation``; the outcome is ``label`` (0 or
    1), and where that is NULL, 1 for the shifts above ``threshold``.  Rows with
    neither, or without a feature, take no part.
    """
    shifts = np.asarray(shifts, float)
    if (np.diff(shifts) < 0).any():
        raise ValueError("shifts must ascend")
    rows = done.dropna(subset=list(features)).filter(F.col(label).isNotNull() | F.col(threshold).isNotNull())
    prof = profile(rows, features)
    keep = [c for c in features if not degenerate(prof[c])]
    width, count = len(keep), len(shifts)
    center, scale = np.array([float(prof[c]["mean"]) for c in keep]), np.array([float(prof[c]["sd"]) for c in keep])
    place = F.when(F.col(label).isNull(), F.size(F.filter(F.array(*[F.lit(float(s)) for s in shifts]), lambda s: s <= F.col(threshold)))).otherwise(F.when(F.col(label) == 1, 0).otherwise(count))
    z = [F.sum((F.col(c) - float(m)) / float(s)).alias(f"_{j}") for j, (c, m, s) in enumerate(zip(keep, center, scale, strict=True))]
    found: dict[int, np.ndarray] = {}
    for r in rows.groupBy("imputation", place.alias("_place")).agg(F.count("*").alias("_n"), *z).collect():
        found.setdefault(r[0], np.zeros((count + 1, width + 1)))[r["_place"]] = [r["_n"], *[r[f"_{j}"] for j in range(width)]]
    if not found:
        raise ValueError("no complete row to fit")
    order = sorted(found)
    linear = np.concatenate([np.cumsum(found[i], axis=0)[:count] for i in order])
    paths = [Path(l2, l1, i) for i in order for _ in shifts]
    packed = blocks(rows.withColumn(label, F.lit(0.0)), keep, label, center, scale, F.col("imputation")).persist()
    seen = done.sparkSession.sparkContext.broadcast([views(np.zeros(width), np.eye(width), ["0" * width])] * len(paths))
    try:
        solve(packed, seen, paths, width, only=True, linear=linear)
    finally:
        packed.unpersist()
        seen.unpersist()
    coef, cov = np.zeros((len(order), count, len(features) + 1)), np.full((len(order), count, len(features) + 1, len(features) + 1), np.nan)
    at = [0, *[1 + features.index(c) for c in keep]]
    for k, p in enumerate(paths):
        active = np.array([True, *(p.theta[1:] != 0)]) if l1 else np.ones(width + 1, bool)
        own, spread = _raw(p.theta, _covariance(p.hessian, active), center, scale)
        coef[k // count, k % count, at] = own
        cov[k // count, k % count][np.ix_(at, at)] = spread
    return Cells(features, shifts, coef, cov)


class MixedCells:
    """Random-intercept regressions of every imputation and shift, by their sums over subjects.

    Only a subject's sums of the columns stay on the cluster.  With a ratio r of
    the variances, V = 1 + r 1 1' of a subject of n rows, and the cross products
    under V are all rows' less r / (1 + n r) times those of the subjects' sums.
    """

    def __init__(self, done: DataFrame, features: list[str], label: str, flag: str, group: str, shifts):
        rows = done.filter(F.col(group).isNotNull()).dropna(subset=[*features, label, flag])
        self.features, self.shifts, self.width = features, np.asarray(shifts, float), len(features)
        columns = [*features, label, flag]
        self.order, self.grams, self.center, self.scale = _grams(rows, columns)
        sums = [F.sum((F.col(c) - float(m)) / float(s)).alias(f"_{j}") for j, (c, m, s) in enumerate(zip(columns, self.center, self.scale, strict=True))]
        self.subjects = rows.groupBy("imputation", group).agg(F.count("*").cast("double").alias("_n"), *sums).drop(group).persist()
        self.moves = [_shifted(self.width, s, self.center, self.scale) for s in self.shifts]

    def sums(self, ratios: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Of each imputation's ratios r the sums over subjects of cc'/(1+nr), cc'/(1+nr)^2, log(1+nr) and n/(1+nr): one job."""
        w = self.width + 3
        size, start, total = 2 * w * w + 2, {}, 0
        for i in self.order:
            start[i] = total
            total += len(ratios[i]) * size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(total)
            for batch in batches:
                name = batch.column(0).to_numpy()
                c = np.stack([batch.column(1 + j).to_numpy() for j in range(w)], 1)
                for i in np.unique(name):
                    own = c[name == i]
                    for k, r in enumerate(ratios[int(i)]):
                        d = 1 / (1 + own[:, 0] * r)
                        part = np.concatenate([(own.T @ (own * d[:, None])).ravel(), (own.T @ (own * (d * d)[:, None])).ravel(), [np.log1p(own[:, 0] * r).sum(), own[:, 0] @ d]])
                        out[start[int(i)] + k * len(part) :][: len(part)] += part
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total)), "v": out})

        flat = np.zeros(total)
        for r in self.subjects.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("s")).collect():
            flat[r["i"]] = r["s"]
        return {i: flat[start[i] :][: len(ratios[i]) * size].reshape(-1, size) for i in self.order}

    def at(self, name: int, shift: int, ratio: float, sums: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, float]:
        """(deviance but for a constant, its slope by the ratio, coefficients, their inverse information, residual variance), standardised."""
        w = self.width + 3
        a = self.moves[shift]
        q = a @ (self.grams[name] - ratio * sums[: w * w].reshape(w, w)) @ a.T
        n, theta = self.grams[name][0, 0], np.linalg.pinv(q[:-1, :-1]) @ q[:-1, -1]
        rss = max(float(q[-1, -1] - theta @ q[:-1, -1]), 1e-300)
        u = np.concatenate([-theta, [1.0]]) @ a
        slope = float(-n * (u @ sums[w * w : 2 * w * w].reshape(w, w) @ u) / rss + sums[-1])
        return n * math.log(rss) + float(sums[-2]), slope, theta, np.linalg.pinv(q[:-1, :-1]), rss / n

    def fit(self, rounds: int = 60, tol: float = 1e-10) -> tuple[Cells, np.ndarray, np.ndarray]:
        """(cells, tau2, sigma2) by maximum likelihood; each round of the search is one job for all cells."""
        known = self.sums({i: RATIOS for i in self.order})
        cells = [(i, k) for i in self.order for k in range(len(self.shifts))]
        lo, hi, best = {}, {}, {}
        for i, k in cells:
            found = [self.at(i, k, r, s) for r, s in zip(RATIOS, known[i], strict=True)]
            j = int(np.argmin([f[0] for f in found]))
            best[i, k] = RATIOS[j], found[j]
            if j == 0 and found[0][1] >= 0:
                continue
            first = j - 1 if found[j][1] > 0 and j else j
            if first + 1 < len(RATIOS):
                lo[i, k], hi[i, k] = (RATIOS[first], found[first][1]), (RATIOS[first + 1], found[first + 1][1])
        for _ in range(rounds):
            live = [c for c in cells if c in lo and hi[c][0] - lo[c][0] > tol * hi[c][0]]
            if not live:
                break
            trial = {c: (lo[c][0] + hi[c][0]) / 2 for c in live}
            chord = {}
            for c in live:
                (x0, f0), (x1, f1) = lo[c], hi[c]
                chord[c] = x0 - f0 * (x1 - x0) / (f1 - f0) if f0 < 0 < f1 else trial[c]
            asked = {i: np.array([v for c in live if c[0] == i for v in (trial[c], chord[c], chord[c] * (1 - tol / 4), chord[c] * (1 + tol / 4))]) for i in self.order}
            known, seen = self.sums(asked), dict.fromkeys(self.order, 0)
            for c in live:
                for r, s in zip(asked[c[0]][seen[c[0]] :][:4], known[c[0]][seen[c[0]] :][:4], strict=True):
                    if lo[c][0] < r < hi[c][0]:
                        found = self.at(*c, r, s)
                        best[c] = r, found
                        side = hi if found[1] > 0 else lo
                        side[c] = r, found[1]
                seen[c[0]] += 4
        shape = (len(self.order), len(self.shifts))
        coef, cov = np.zeros((*shape, self.width + 1)), np.zeros((*shape, self.width + 1, self.width + 1))
        tau2, sigma2 = np.zeros(shape), np.zeros(shape)
        for i, k in cells:
            at = self.order.index(i), k
            ratio, (_, _, theta, inverse, s2) = best[i, k]
            coef[at], cov[at] = _raw(theta, s2 * inverse, self.center[: self.width], self.scale[: self.width], (self.center[self.width], self.scale[self.width]))
            sigma2[at] = s2 * self.scale[self.width] ** 2
            tau2[at] = ratio * sigma2[at]
        return Cells(self.features, self.shifts, coef, cov), tau2, sigma2

    def release(self) -> None:
        self.subjects.unpersist()


def mixed_cells(done: DataFrame, features: list[str], label: str, flag: str, group: str, shifts) -> Cells:
    """Random-intercept regressions of every imputation and shift; rows without a group or a cell take no part."""
    cells = MixedCells(done, features, label, flag, group, shifts)
    try:
        return cells.fit()[0]
    finally:
        cells.release()


def _thresholds(done: DataFrame, features: list[str], own: str, key: str, seed: int, l2: float, l1: float, name: str) -> DataFrame:
    """Adds the shift of the log odds beyond which a missing 0/1 outcome is drawn as 1.

    The log odds are those of each imputation's fit to the observed outcomes, at
    coefficients drawn from its normal approximation; the uniform number is a
    fixed function of (seed, imputation, key).
    """
    observed = logistic_cells(done.filter(F.col(own).isNotNull()).withColumn(name, F.lit(None).cast("double")), features, own, name, [0.0], l2, l1)
    drawn = []
    for i, (theta, cov) in enumerate(zip(observed.coef[:, 0], observed.cov[:, 0], strict=True)):
        low, vectors = np.linalg.eigh(np.nan_to_num(cov))
        drawn.append(theta + vectors @ (np.sqrt(np.maximum(low, 0)) * np.random.default_rng([seed, i]).normal(size=len(theta))))
    of = [F.array(*[F.lit(float(d[j])) for d in drawn])[F.col("imputation") - 1] for j in range(len(features) + 1)]
    odds = sum((w * F.col(c) for w, c in zip(of[1:], features, strict=True)), of[0])
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "imputation", key), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return done.withColumn(name, F.when(F.col(own).isNull(), F.log(u / (1 - u)) - odds))


def sweep(df: DataFrame, features: list[str], label: str, key: str, family: str = "linear", group: str | None = None, imputations: int = 5, deltas: int = 25, reach: float = 3.0, seed: int = 0, alpha: float | None = None, posterior: bool = False) -> DataFrame:
    """(feature, delta_std, coef, se): pooled coefficients with missing outcomes shifted by -reach to reach.

    family: linear, ridge, lasso, mixed (with ``group``), or logistic; ridge and
    lasso of an outcome of 0 and 1 are logistic.  A shift counts standard deviations
    of the observed outcome, for a logistic one units of the log odds.  Families
    without coefficients are refused.
    """
    check_choice(family, FAMILIES, "family", "a sensitivity sweep")
    check_positive_int(imputations, "imputations", "a sensitivity sweep", 1)
    if family == "mixed" and not group:
        raise ValueError("a mixed sweep needs a group")
    own, flag = "_observed_outcome", "_missing_outcome"
    seen = df.agg(F.stddev_samp(label).alias("sd"), F.count(label).alias("n"), F.count_if((F.col(label) == 0) | (F.col(label) == 1)).alias("binary")).first()
    if not seen["n"]:
        raise ValueError(f"{label} is never observed")
    binary = seen["n"] == seen["binary"]
    if family == "logistic" and not binary:
        raise ValueError(f"{label} is not 0 or 1")
    columns = [F.col(c) for c in dict.fromkeys([key, *features, label, *([group] if group else [])])]
    rows = df.select(*columns, F.col(label).cast("double").alias(own), F.col(label).isNull().cast("double").alias(flag))
    done = multiple_imputation(rows, features, key, imputations, seed, posterior, label).persist()
    grid = np.linspace(-reach, reach, deltas)
    l2 = (1.0 if family == "ridge" else 0.01 if family == "logistic" else 0.0) if alpha is None or family == "lasso" else alpha
    l1 = (1.0 if alpha is None else alpha) if family == "lasso" else 0.0
    try:
        if family == "logistic" or (binary and family in ("ridge", "lasso")):
            ready = _thresholds(done, features, own, key, seed, l2, l1, flag)
            return logistic_cells(ready, features, own, flag, grid, l2, l1).curve(df.sparkSession)
        sd = float(seen["sd"] or 1.0)
        if family == "mixed":
            return mixed_cells(done, features, label, flag, group, grid * sd).curve(df.sparkSession, sd)
        return linear_cells(done, features, label, flag, grid * sd, l2, l1).curve(df.sparkSession, sd)
    finally:
        done.unpersist()
