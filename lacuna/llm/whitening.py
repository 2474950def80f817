"""Embedding whitening by hierarchical SVD merging.

Every partition of the distinct vectors keeps a summary: how many, their mean,
and all singular values and right vectors of the centred matrix.  Two summaries
merge by stacking their scaled right vectors and one row for the distance of
their means, and decomposing that again, which gives what one decomposition of
all rows would give, in every dimension.  Summaries merge in a tree on the
cluster; a single one reaches the driver.  Sums are exact whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import vectors
from lacuna.llm.shared import materialise, tidied

#: Rows decomposed at a time; summaries merged by one task of the tree.
CHUNK_ROWS = 2048
FAN = 8

SUMMARY = "node long, n long, high array<long>, low array<long>, mean array<double>, s array<double>, vt binary"


@dataclass
class Summary:
    """n rows with their mean; ``s`` and ``vt`` decompose the centred rows, all dimensions kept."""

    n: int
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray
    sums: list[int]

    @classmethod
    def of(cls, x: np.ndarray, sums: list[int] | None = None) -> Summary:
        mean = x.mean(0)
        s, vt = np.linalg.svd(x - mean, full_matrices=False)[1:]
        return cls(len(x), mean, s, vt, [0] * x.shape[1] if sums is None else sums)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        gap = other.mean - self.mean
        correction = math.sqrt(self.n / n * other.n) * gap
        s, vt = np.linalg.svd(np.concatenate([self.s[:, None] * self.vt, other.s[:, None] * other.vt, correction[None]]), full_matrices=False)[1:]
        return Summary(n, self.mean + gap * (other.n / n), s, vt, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    def row(self, node: int) -> dict:
        high, low = vectors.limbs(self.sums)
        return {"node": node, "n": self.n, "high": high, "low": low, "mean": self.mean.tolist(), "s": self.s.tolist(), "vt": self.vt.astype("<f8").tobytes()}

    @classmethod
    def from_row(cls, r: dict) -> Summary:
        width = len(r["mean"])
        return cls(r["n"], np.array(r["mean"], float), np.array(r["s"], float), np.frombuffer(r["vt"], "<f8").reshape(-1, width), vectors.unlimbed(r["high"], r["low"]))


_KIND = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("s", pa.list_(pa.float64())), ("vt", pa.binary())])


def summarise(rows: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Summary | None:
    """The summary of all ``x`` (whole numbers of one length); ``change`` maps a matrix of them first, and then no sums are kept.

    One row per partition is written to the shared folder, and these merge
    ``FAN`` at a time until one is left.
    """

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = None, []

        def taken() -> Summary:
            x = np.concatenate(held)
            own = Summary.of(x.astype(np.float64), vectors.exact_sum(x)) if change is None else Summary.of(change(x))
            return own if found is None else found.merge(own)

        for batch in batches:
            held.append(vectors.matrix(batch.column(0), width))
            if sum(map(len, held)) >= CHUNK_ROWS:
                found, held = taken(), []
        if any(map(len, held)):
            found = taken()
        if found is not None:
            yield pa.RecordBatch.from_pylist([found.row(TaskContext.get().partitionId())], _KIND)

    def merged(group: pa.Table) -> pa.Table:
        parts = [Summary.from_row(r) for r in sorted(group.to_pylist(), key=lambda r: r["node"])]
        return pa.Table.from_pylist([reduce(Summary.merge, parts).row(group.column("node")[0].as_py() // FAN)], _KIND)

    nodes = materialise(rows.select("x").mapInArrow(tidied(leaf), SUMMARY))
    last = nodes.agg(F.max("node")).first()[0]
    while last:
        nodes, last = nodes.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(merged, SUMMARY), last // FAN
    row = nodes.first()
    return None if row is None else Summary.from_row(row.asDict(recursive=True))


@dataclass
class Whitening:
    """Components of the distinct vectors by falling variance; ``identity_error`` is how far the whitened rows' covariance is from the identity."""

    factor: float
    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    total: float
    components: int
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float | None]:
        """Share of each component in the summed variance; None where nothing varies."""
        return [float(e / self.total) if self.total else None for e in self.variances[: self.components]]

    @property
    def spread(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        top = self.variances.max(initial=0.0)
        return self.variances[: self.components] > top * (max(self.n, self.width) * np.finfo(float).eps) ** 2 if top else np.zeros(self.components, bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whole vectors to whitened ones; NaN in components without variance."""
        exact = self.n * float(np.abs(x.astype(np.float64)).max(initial=0)) < 1 << 62 and max(map(abs, self.sums), default=0) < 1 << 62
        kind = np.int64 if exact else object
        centred = (self.n * x.astype(kind) - np.array(self.sums, kind)).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            out = centred @ self.vectors[: self.components].T / np.sqrt(self.variances[: self.components])
        return np.where(self.spread, out, np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - sum)^2, exact; the largest long where it is more."""
        if not self.width:
            return [0] * len(x)
        top = self.n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(map(abs, self.sums))
        kind = np.int64 if self.width * top * top < 1 << 62 else object
        d = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [vectors.as_long(v) for v in (d * d).sum(1)]


def whole(vec: str, factor: float) -> Column:
    return vectors.whole(F.col(vec), factor)


def fit(df: DataFrame, vec: str, factor: float = 256.0, components: int | None = None) -> Whitening | None:
    """Whitening of ``floor(factor * c)``, fitted to each distinct vector once; None without vectors.

    Vectors that are null or hold null or non-finite components take no part,
    nor do vectors of another length than the most frequent one.  All dimensions
    are decomposed; ``components`` says how many are applied (default: all).
    Components without variance (one vector only, or constant directions) whiten
    to null and do not count for the identity error.
    """
    rows = vectors.kept(df, vec, whole(vec, factor))
    usual = vectors.common_length(rows)
    if usual is None:
        return None
    width = usual[0]
    distinct = materialise(rows.filter(F.size("x") == width).select("x").distinct())
    found = summarise(distinct, width)
    s, vt = np.zeros(width), np.zeros((width, width))
    s[: len(found.s)], vt[: len(found.s)] = found.s, found.vt
    for v in vt:  # the largest entry of each component is positive
        if len(v) and v[np.abs(v).argmax()] < 0:
            v *= -1
    variances = s * s / found.n
    model = Whitening(factor, found.n, found.sums, vt, variances, float(variances.sum()), width if components is None else min(components, width))
    if model.spread.any():
        on = np.nonzero(model.spread)[0]
        back = summarise(distinct, width, lambda x: model.project(x)[:, on])
        covariance = (back.vt.T * (back.s**2 / back.n)) @ back.vt
        model.identity_error = float(np.abs(covariance - np.eye(len(on))).max())
    return model


def apply(df: DataFrame, vec: str, model: Whitening, whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows whose vector the model fits, with ``whitened`` (array<double>) and ``deviation`` (long); columns of these names give way."""
    own = [c for c in df.columns if c.lower() not in (whitened.lower(), deviation.lower())]
    rows = vectors.kept(df.select(*own), vec, whole(vec, model.factor)).filter(F.size("x") == model.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1), model.width)
            z = model.project(x)
            flat = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(model.deviations(x), pa.int64())], names=["row", "_whitened", "_deviation"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, _whitened array<double>, _deviation long")
    return out.select("row.*", F.col("_whitened").alias(whitened), F.col("_deviation").alias(deviation))
