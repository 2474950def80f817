"""Maximum likelihood for incomplete Gaussian data, on pattern blocks alone.

The E-step sweeps the parameters over a tree of nested patterns: a node at depth
j has taken the first j columns as observed or missing, so patterns that begin
alike share their sweeps, and the nodes of a depth are swept together.  Beyond
``DRIVER_PATTERNS`` patterns the blocks stay on the cluster: each E-step is a job
that broadcasts mean and covariance and adds up expected sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.exprs import mask
from lacuna.plans import patterns
from lacuna.plans.patterns import Patterns


@dataclass
class Moments:
    """Mean and covariance on the standardised scale of ``patterns``, and the log-likelihood reached."""

    mu: np.ndarray
    sigma: np.ndarray
    loglik: float
    iterations: int


def conditional(mu: np.ndarray, sigma: np.ndarray, obs: np.ndarray, mis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(K, b, C): missing given observed has mean K x + b and covariance C."""
    if not len(obs):
        return np.zeros((len(mis), 0)), mu[mis], sigma[np.ix_(mis, mis)]
    soo = sigma[np.ix_(obs, obs)]
    try:
        k = np.linalg.solve(soo, sigma[np.ix_(obs, mis)]).T
    except np.linalg.LinAlgError:
        k = (np.linalg.pinv(soo) @ sigma[np.ix_(obs, mis)]).T
    c = sigma[np.ix_(mis, mis)] - k @ sigma[np.ix_(obs, mis)]
    return k, mu[mis] - k @ mu[obs], (c + c.T) / 2


def loglik(p: Patterns, mu: np.ndarray, sigma: np.ndarray) -> float:
    """Observed-data log-likelihood; patterns without positive definite covariance are skipped."""
    total = 0.0
    for b in p.blocks.values():
        if not len(b.obs):
            continue
        s = sigma[np.ix_(b.obs, b.obs)]
        try:
            chol = np.linalg.cholesky(s)
        except np.linalg.LinAlgError:
            continue
        m = mu[b.obs]
        scatter = b.q - np.outer(b.s, m) - np.outer(m, b.s) + b.n * np.outer(m, m)
        half = np.linalg.solve(chol, np.linalg.solve(chol, scatter).T)
        total -= 0.5 * (b.n * (len(b.obs) * math.log(2 * math.pi) + 2 * np.log(np.diag(chol)).sum()) + np.trace(half))
    return total


def filled(p: Patterns, mu: np.ndarray, sigma: np.ndarray, over: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """Per pattern (n, sum of filled rows, cross products of filled rows, conditional covariance of a row).

    A filled row is affine in the observed values, so its sums follow from the block's.
    ``over`` limits the columns (others are left out of the filling).
    """
    out = []
    every = np.arange(len(mu)) if over is None else over
    for b in p.blocks.values():
        keep = np.isin(b.obs, every)
        obs = b.obs[keep]
        s, q = b.s[keep], b.q[np.ix_(keep, keep)]
        mis = np.setdiff1d(every, obs)
        k, shift, c = conditional(mu, sigma, obs, mis)
        width = len(every)
        place = {j: i for i, j in enumerate(every)}
        lin, const, cov = np.zeros((width, len(obs))), np.zeros(width), np.zeros((width, width))
        oi, mi = [place[j] for j in obs], [place[j] for j in mis]
        lin[oi, range(len(obs))] = 1
        lin[mi] = k
        const[mi] = shift
        cov[np.ix_(mi, mi)] = c
        total = lin @ s + b.n * const
        cross = lin @ q @ lin.T + np.outer(lin @ s, const) + np.outer(const, lin @ s) + b.n * np.outer(const, const)
        out.append((b.n, total, cross, cov))
    return out


#: Bytes of parameter matrices that are swept at once.
SWEPT_BYTES = 32 << 20


class Tree:
    """Patterns (rows of ``seen``, sorted) as a tree of their prefixes: for each column, the parent of every node and whether it took the column as observed."""

    def __init__(self, seen: np.ndarray):
        self.seen = seen
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        node = np.zeros(len(seen), int)
        for j in range(seen.shape[1]):
            # sorted rows: a new node begins where the prefix changes
            new = np.ones(len(seen), bool)
            new[1:] = (node[1:] != node[:-1]) | (seen[1:, j] != seen[:-1, j])
            self.levels.append((node[new], seen[new, j]))
            node = np.cumsum(new) - 1

    def swept(self, mu: np.ndarray, sigma: np.ndarray, tol: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
        """Every pattern's augmented parameter matrix, swept on its observed columns, and the log determinant of their covariance.

        A column that the ones before determine is left unswept, as a generalised inverse would.
        """
        w = np.block([[-np.ones((1, 1)), mu[None]], [mu[:, None], sigma]])[None]
        logdet = np.zeros(1)
        least = tol * np.diag(sigma)
        for j, (parent, on) in enumerate(self.levels):
            w, logdet = w[parent], logdet[parent]
            at = np.flatnonzero(on & (w[:, j + 1, j + 1] > least[j]))
            if not len(at):
                continue
            own = w[at]
            pivot = own[:, j + 1, j + 1].copy()
            line = own[:, j + 1] / pivot[:, None]
            own -= own[:, :, j + 1, None] * line[:, None]
            own[:, j + 1] = own[:, :, j + 1] = line
            own[:, j + 1, j + 1] = -1 / pivot
            w[at] = own
            logdet[at] += np.log(pivot)
        return w, logdet


@dataclass
class Stack:
    """Blocks of many patterns as arrays: whether a column is seen, and the augmented sums (n, s; s, q), in the tree's order."""

    trees: list[Tree]
    sums: list[np.ndarray]

    @classmethod
    def of(cls, blocks: list[patterns.Block], width: int) -> Stack:
        blocks = [b for b in blocks if len(b.obs)]
        seen = np.zeros((len(blocks), width), bool)
        for i, b in enumerate(blocks):
            seen[i, b.obs] = True
        order = np.lexsort(seen.T[::-1]) if len(blocks) else np.empty(0, int)
        step = max(1, SWEPT_BYTES // (8 * (width + 1) ** 2))
        trees, sums = [], []
        for a in range(0, len(order), step):
            some = order[a : a + step]
            trees.append(Tree(seen[some]))
            total = np.zeros((len(some), width + 1, width + 1))
            for i, k in enumerate(some):
                b = blocks[k]
                at = 1 + b.obs
                total[i, 0, 0], total[i, 0, at], total[i, at, 0] = b.n, b.s, b.s
                total[i][np.ix_(at, at)] = b.q
            sums.append(total)
        return cls(trees, sums)

    def expected(self, mu: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, float]:
        """(augmented sums of the filled rows with the conditional covariances, log-likelihood at these parameters)."""
        width = len(mu)
        out, loglik = np.zeros((width + 1, width + 1)), 0.0
        for tree, sums in zip(self.trees, self.sums, strict=True):
            w, logdet = tree.swept(mu, sigma)
            n = sums[:, 0, 0]
            known = np.concatenate([np.ones((len(n), 1), bool), tree.seen], 1)
            both = known[:, :, None] & known[:, None, :]
            quad = -(np.where(both, w, 0) * sums).sum((1, 2)) - n
            loglik -= 0.5 * float((n * (tree.seen.sum(1) * math.log(2 * math.pi) + logdet) + quad).sum())
            lin = np.where(known[:, None, :] & ~known[:, :, None], w.transpose(0, 2, 1), 0)
            at = np.arange(width + 1)
            lin[:, at, at] = known
            out += (lin @ sums @ lin.transpose(0, 2, 1)).sum(0)
            out += np.einsum("g,gij->ij", n, np.where(~known[:, :, None] & ~known[:, None, :], w, 0))
        return out, loglik


def _start(total: np.ndarray, count: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise available moments, made positive definite."""
    many = np.maximum(count, 1)
    mu = np.diag(shift) / np.maximum(np.diag(count), 1)
    sigma = np.where(count > 1, total / many - (shift / many) * (shift.T / many), 0.0)
    low, vectors = np.linalg.eigh((sigma + sigma.T) / 2)
    return mu, vectors @ np.diag(np.maximum(low, 1e-6)) @ vectors.T


def _iterated(expected, mu: np.ndarray, sigma: np.ndarray, max_iter: int, tol: float, reg: float) -> Moments:
    """EM with ``expected(mu, sigma)`` as its E-step, until the log-likelihood stands."""
    old, it = -math.inf, 0
    sums, now = expected(mu, sigma)
    for it in range(1, max_iter + 1):
        if not sums[0, 0]:
            break
        mu = sums[0, 1:] / sums[0, 0]
        sigma = sums[1:, 1:] / sums[0, 0] - np.outer(mu, mu) + reg * np.eye(len(mu))
        sums, now = expected(mu, sigma)
        if abs(now - old) < tol * (1 + abs(now)):
            break
        old = now
    return Moments(mu, sigma, now, it)


def pairwise(blocks: list[patterns.Block], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the blocks that see both columns: (cross products, counts, sums)."""
    n, s, q = np.zeros((width, width)), np.zeros((width, width)), np.zeros((width, width))
    for b in blocks:
        at = np.ix_(b.obs, b.obs)
        n[at] += b.n
        s[at] += b.s[:, None]
        q[at] += b.q
    return q, n, s


#: A covariance on the standardised scale with a smaller eigenvalue keeps its ridge.
LEAST_SPREAD = 1e-5


def _settled(expected, m: Moments, max_iter: int, tol: float = 1e-14) -> Moments:
    """EM from given moments without a ridge until the parameters themselves stand; where columns determine each other the moments stay as given.

    The log-likelihood of many rows stands long before its parameters do, and a
    ridge moves them by its size: both show in the digits of single predictions.
    """
    mu, sigma, now = m.mu, m.sigma, m.loglik
    for it in range(max_iter):
        if not len(mu) or np.linalg.eigvalsh(sigma)[0] < LEAST_SPREAD:
            return m
        sums, now = expected(mu, sigma)
        if not sums[0, 0]:
            return m
        new = sums[0, 1:] / sums[0, 0]
        spread = sums[1:, 1:] / sums[0, 0] - np.outer(new, new)
        gap = max(np.abs(new - mu).max(), np.abs(spread - sigma).max())
        mu, sigma = new, (spread + spread.T) / 2
        if gap < tol:
            break
    return Moments(mu, sigma, now, m.iterations + it + 1) if np.linalg.eigvalsh(sigma)[0] >= LEAST_SPREAD else m


def em(p: Patterns, max_iter: int = 500, tol: float = 1e-10, reg: float = 0.0, settle: bool = False) -> Moments:
    """EM from pairwise available moments; all iterations are driver algebra on the blocks.

    With ``settle`` the ridge is then left out, and the parameters iterated until they stand.
    """
    blocks = list(p.blocks.values())
    stack = Stack.of(blocks, len(p.columns))
    m = _iterated(stack.expected, *_start(*pairwise(blocks, len(p.columns))), max_iter, tol, reg)
    return _settled(stack.expected, m, max_iter) if settle else m


#: More patterns than this are kept on the cluster by ``moments``.
DRIVER_PATTERNS = 4000


@dataclass
class Spread:
    """Pattern blocks that stay on the cluster: rows of a pattern with its packed sums, moved to ``center`` and ``scale``."""

    columns: list[str]
    center: np.ndarray
    scale: np.ndarray
    rows: DataFrame
    parts: patterns.Parts

    def _added(self, make) -> np.ndarray:
        """The sum over all tasks of ``make(blocks)``, an array; tasks' arrays are added by the driver, of which there are as many as tasks."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                own = make([parts.block(r) for r in batch.to_pylist()])
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        found = [np.frombuffer(r["sums"]) for r in self.rows.mapInArrow(run, "sums binary").collect()]
        return np.sum(sorted(found, key=lambda v: v.tobytes()), axis=0)

    def em(self, max_iter: int = 500, tol: float = 1e-10, reg: float = 0.0) -> Moments:
        width = len(self.columns)
        start = self._added(lambda blocks: np.concatenate([x.ravel() for x in pairwise(blocks, width)])).reshape(3, width, width)

        def expected(mu: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, float]:
            def make(blocks: list[patterns.Block]) -> np.ndarray:
                sums, loglik = Stack.of(blocks, width).expected(mu, sigma)
                return np.append(sums.ravel(), loglik)

            total = self._added(make)
            return total[:-1].reshape(width + 1, width + 1), float(total[-1])

        return _iterated(expected, *_start(*start), max_iter, tol, reg)


def moments(df: DataFrame, columns: list[str], max_iter: int = 500, tol: float = 1e-10, reg: float = 0.0, most: int | None = None, settle: bool = False) -> tuple[Patterns | Spread, Moments]:
    """The blocks and EM moments of ``columns``: on the driver up to ``DRIVER_PATTERNS`` patterns, on the cluster beyond, with no bound on their number.

    ``settle`` is that of ``em``; on the cluster, where an iteration is a job, the moments stay those of the ridge.
    """
    found = patterns.gathered(df, columns, DRIVER_PATTERNS if most is None else most)
    if isinstance(found, Patterns):
        return found, em(found, max_iter, tol, reg, settle)
    spread = Spread(columns, *found)
    try:
        return spread, spread.em(max_iter, tol, reg)
    finally:
        spread.rows.unpersist()


def raw_moments(p: Patterns | Spread, m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance on the scale of the data."""
    return p.center + p.scale * m.mu, m.sigma * np.outer(p.scale, p.scale)


def per_pattern(columns: list[str], masks: list[str], build) -> Column:
    """CASE over the patterns; ``build(observed, missing)`` gives each one's expression."""
    key = mask(columns)
    case = F.lit(None).cast("double")
    for m in sorted(masks):
        obs = [i for i, c in enumerate(m) if c == "0"]
        mis = [i for i, c in enumerate(m) if c == "1"]
        case = F.when(key == m, build(obs, mis)).otherwise(case)
    return case


def conditional_mean(columns: list[str], mu: np.ndarray, sigma: np.ndarray, target: int, masks: list[str]) -> Column:
    """Column ``target`` where observed, else its mean given the row's observed columns (raw scale)."""

    def build(obs: list[int], mis: list[int]) -> tuple[float, list[float]]:
        if target in obs:
            return 0.0, [float(j == target) for j in obs]
        k, shift, _ = conditional(mu, sigma, np.array(obs, int), np.array([target]))
        return float(shift[0]), k[0].tolist()

    return F.coalesce(F.col(columns[target]), affine(columns, [m for m in masks if m[target] == "1"] or masks[:1], build))


#: Terms up to which an affine map per pattern is a CASE expression.
CASE_TERMS = 4000


def affine(columns: list[str], masks: list[str], build) -> Column:
    """const + weights of the observed columns, by pattern; ``build(observed, missing)`` gives (const, weights).

    Few patterns become a CASE; many are looked up in a table that is no larger
    than the patterns' bound, in Arrow batches.
    """
    if len(masks) * (1 + len(columns)) <= CASE_TERMS:

        def expression(obs: list[int], mis: list[int]) -> Column:
            const, weights = build(obs, mis)
            out = F.lit(float(const))
            for j, w in zip(obs, weights, strict=True):
                out = out + F.lit(float(w)) * F.col(columns[j])
            return out

        return per_pattern(columns, masks, expression)
    table = np.zeros((len(masks), 1 + len(columns)))
    for i, m in enumerate(masks):
        obs, mis = ([j for j, c in enumerate(m) if c == v] for v in "01")
        const, weights = build(obs, mis)
        table[i, 0] = const
        table[i, [1 + j for j in obs]] = weights
    place = {m: i for i, m in enumerate(masks)}

    @F.pandas_udf("double")
    def run(pattern: pd.Series, values: pd.DataFrame) -> pd.Series:
        at = pattern.map(place).to_numpy(dtype=float)
        known = ~np.isnan(at)
        own = table[np.where(known, at, 0).astype(int)]
        out = own[:, 0] + (own[:, 1:] * np.nan_to_num(values.to_numpy(dtype=float))).sum(1)
        return pd.Series(out).where(known, None)

    return run(mask(columns), F.struct(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]))


def all_masks(width: int) -> list[str]:
    return [format(i, f"0{width}b") for i in range(1 << width)]
