"""Missingness patterns and their additive sufficient statistics.

For Gaussian models a pattern enters a likelihood only through its row count,
sums and cross products.  One aggregation collects them for all patterns (and,
if asked, for each fold or group besides); blocks add, so folds, bootstrap
weights and stream increments need no second scan.

Sums are order-free.  Values are moved to [-1, 1] by the column's ends, and what
is summed is whole numbers: every summand is cut into a high and a low long on a
common exponent, so that no addition rounds and any partitioning, retry or merge
gives the same bits.  Means and spreads follow from the exact sums.

Few columns are summed by column expressions.  For many, whose p(p+1)/2 products
would not compile, every partition keeps one packed triangular array per pattern,
filled by matrix products of Arrow batches (the values cut into pieces so short
that a product of matrices is exact), and the arrays merge in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.exprs import mask

#: More patterns than this are refused: the driver's algebra costs G p^3.
MAX_PATTERNS = 20_000
#: More columns than this are summed by matrix products.
NARROW = 8
#: Rows of a matrix product; bytes of batches a task gathers so that its patterns fill such products; bytes of arrays a task holds before it hands them on; arrays merged by one task of the tree.
SLAB_ROWS = 4096
GATHERED_BYTES = 24 << 20
HELD_BYTES = 64 << 20
FAN = 64
#: Levels of the tree; what more than FAN ** LEVELS partitions leave over is added by the driver.
LEVELS = 2


@dataclass
class Block:
    """n rows with the columns ``obs`` observed: sums s and cross products q of the shifted columns."""

    obs: np.ndarray
    n: float
    s: np.ndarray
    q: np.ndarray

    def __add__(self, other: Block) -> Block:
        return Block(self.obs, self.n + other.n, self.s + other.s, self.q + other.q)


@dataclass
class Patterns:
    """The blocks of all patterns of ``columns``; values are shifted by ``center`` and divided by ``scale``."""

    columns: list[str]
    center: np.ndarray
    scale: np.ndarray
    blocks: dict[str, Block]

    @property
    def n(self) -> float:
        return sum(b.n for b in self.blocks.values())

    def merge(self, other: Patterns) -> Patterns:
        blocks = dict(self.blocks)
        for key, b in other.blocks.items():
            blocks[key] = blocks[key] + b if key in blocks else b
        return Patterns(self.columns, self.center, self.scale, blocks)


def profile(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """count, mean, sd, min and max of each column's observed values, in one job; of many columns in Arrow batches, as their aggregates would not compile."""
    if len(columns) > NARROW:
        return _wide_profile(df, columns)
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}")]
    row = df.agg(F.count("*").alias("rows"), *aggs).first()
    return {c: {"rows": row["rows"], "n": row[f"n_{c}"], "mean": row[f"m_{c}"], "sd": row[f"s_{c}"], "min": row[f"a_{c}"], "max": row[f"b_{c}"]} for c in columns}


@contextmanager
def compilable(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside run many column expressions as methods short enough for the JVM to compile (it interprets those above 8000 bytes); the setting is put back."""
    name = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lines (n, mean, squares about the mean, min, max) of two disjoint sets of rows as those of both."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    return np.stack([n, mean, a[2] + b[2] + gap * gap * a[0] * share, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])])


def _wide_profile(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """``profile`` by one packed array of each partition, merged in the partitions' order."""
    width = len(columns)
    cells = df.select(*[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.stack([np.zeros(width), np.zeros(width), np.zeros(width), np.full(width, np.inf), np.full(width, -np.inf)])
        for batch in batches:
            rows += batch.num_rows
            own = np.stack([np.zeros(width), np.zeros(width), np.zeros(width), np.full(width, np.inf), np.full(width, -np.inf)])
            with np.errstate(invalid="ignore"):
                for j in range(width):
                    v = batch.column(j)
                    v = (v.drop_null() if v.null_count else v).to_numpy()
                    if len(v):
                        mean = v.mean()
                        own[:, j] = len(v), mean, np.square(v - mean).sum(), v.min(), v.max()
                total = _merged(total, own)
        if rows:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "rows": pa.array([rows], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    with compilable(df.sparkSession):
        found = sorted(cells.mapInArrow(run, "part long, rows long, data binary").collect(), key=lambda r: r["part"])  # a line per partition
    rows, total = 0, None
    with np.errstate(invalid="ignore"):
        for r in found:
            own = np.frombuffer(r["data"]).reshape(5, width)
            rows, total = rows + r["rows"], own if total is None else _merged(total, own)
    out = {}
    for j, c in enumerate(columns):
        n, mean, squares, low, high = (float(x) for x in total[:, j]) if total is not None else (0.0, 0.0, 0.0, 0.0, 0.0)
        out[c] = {"rows": rows, "n": int(n), "mean": mean if n else None, "sd": math.sqrt(squares / (n - 1)) if n > 1 else None, "min": low if n else None, "max": high if n else None}
    return out


def degenerate(p: dict, rtol: float = 1e-12) -> bool:
    """Fewer than two values, one value, or a spread lost in rounding."""
    if p["n"] < 2 or p["min"] == p["max"]:
        return True
    return not p["sd"] or p["sd"] <= rtol * max(abs(p["min"]), abs(p["max"]))


@dataclass(frozen=True)
class Digits:
    """How summands are cut: value = high 2^-e + low 2^-(e + f), for sums (s) and cross products (q)."""

    s: tuple[int, int]
    q: tuple[int, int]
    piece: int = 0
    pieces: int = 0

    @classmethod
    def narrow(cls, rows: int) -> Digits:
        room = 61 - max(1, rows).bit_length()
        return cls((min(52, room), min(40, room)), (min(52, room), min(40, room)))

    @classmethod
    def wide(cls, rows: int) -> Digits:
        piece = min(18, (61 - max(1, rows).bit_length()) // 2)
        pieces = math.ceil(48 / piece)
        return cls((piece, piece * (pieces - 1)), (2 * piece, piece * (pieces - 1)), piece, pieces)


def _settled(levels: list[np.ndarray], piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of sums given piece by piece, the highest first: what a lower one exceeds its digits by is carried up."""
    low, carry, place = np.zeros_like(levels[0]), np.zeros_like(levels[0]), 0
    for v in reversed(levels[1:]):
        v = v + carry
        low |= (v & ((1 << piece) - 1)) << place
        carry, place = v >> piece, place + piece
    return levels[0] + carry, low


@lru_cache(maxsize=256)
def _upper(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def _products(z: np.ndarray, digits: Digits) -> np.ndarray:
    """The packed sums of a matrix: high and low of its column sums, then of the upper triangle of its cross products."""
    b, count = digits.piece, digits.pieces
    parts, rest = [], z
    for _ in range(count):
        rest = rest * float(1 << b)
        parts.append(np.floor(rest))
        rest = rest - parts[-1]
    s = _settled([p.sum(0).astype(np.int64) for p in parts], b)
    levels = []
    for level in range(count):  # pieces i and j with i + j = level
        total = np.zeros((z.shape[1], z.shape[1]))
        for i in range(level // 2 + 1):
            own = parts[i].T @ parts[level - i]
            total += own if 2 * i == level else own + own.T
        levels.append(total[_upper(z.shape[1])].astype(np.int64))
    return np.concatenate([*s, *_settled(levels, b)])


def _carried(data: np.ndarray, width: int, digits: Digits) -> np.ndarray:
    """Packed sums whose low parts are digits again after additions."""
    out, at = data.copy(), 0
    for size, (_, f) in ((width, digits.s), (width * (width + 1) // 2, digits.q)):
        low = out[at + size : at + 2 * size]
        out[at : at + size] += low >> f
        out[at + size : at + 2 * size] = low & ((1 << f) - 1)
        at += 2 * size
    return out


def gathered_batches(batches: Iterator[pa.RecordBatch], most: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in fewer, larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _tallies(width: int, by: int, mid: np.ndarray, half: np.ndarray, digits: Digits):
    """Rows (by.., cells..) to packed sums by group and pattern, a few for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size, schema = 0, None

        def handed() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0][i] for k in keys], schema.field(i).type) for i in range(by)]
            columns += [pa.array([k[1] for k in keys], pa.string()), pa.array([TaskContext.get().partitionId()] * len(keys), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tobytes() for v in held.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*schema.names[:by], "mask", "node", "n", "data"])

        for batch in gathered_batches(batches):
            schema = batch.schema
            x = np.stack([batch.column(by + j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)], 1)
            gone = np.isnan(x)
            z = (x - mid) / half
            key = np.unique(np.packbits(gone, axis=1), axis=0, return_inverse=True)[1].ravel()
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(by)), strict=True)) if by else None
            if groups:
                number = {g: i for i, g in enumerate(dict.fromkeys(groups))}
                key = key * len(number) + np.array([number[g] for g in groups])
            order = np.argsort(key, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if not len(rows):
                    continue
                obs = ~gone[rows[0]]
                name = (groups[rows[0]] if groups else (), "".join("01"[int(g)] for g in gone[rows[0]]))
                for a in range(0, len(rows), SLAB_ROWS):
                    some = rows[a : a + SLAB_ROWS]
                    data = _products(z[some][:, obs], digits)
                    if name in held:
                        held[name][0] += len(some)
                        held[name][1] = _carried(held[name][1] + data, int(obs.sum()), digits)
                    else:
                        held[name] = [len(some), data]
                        size += data.nbytes
            if size > HELD_BYTES:
                yield handed()
                held, size = {}, 0
        if held:
            yield handed()

    return run


def _summed(columns: list[str], digits: Digits):
    def run(table: pa.Table) -> pa.Table:
        pattern = table.column("mask")[0].as_py()
        data = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("data"))
        row = {c: table.column(c)[:1] for c in columns}
        own = _carried(data, pattern.count("0"), digits).tobytes()
        return pa.table(row | {"node": pa.array([table.column("node")[0].as_py() // FAN], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "data": pa.array([own], pa.binary())})

    return run


def wide_sums(df: DataFrame, columns: list[str], by: tuple[str, ...], mid: np.ndarray, half: np.ndarray, digits: Digits) -> DataFrame:
    """(by.., mask, node, n, data): the packed sums of every group and pattern, merged ``LEVELS`` times."""
    cells = df.select(*by, *[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(columns)])
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("mask", T.StringType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])
    rows = cells.mapInArrow(_tallies(len(columns), len(by), mid, half, digits), schema)
    for _ in range(LEVELS):
        rows = rows.groupBy(*by, "mask", F.floor(F.col("node") / FAN)).applyInArrow(_summed([*by, "mask"], digits), schema)
    return rows


def _weighted_products(z: np.ndarray, w: np.ndarray, digits: Digits) -> np.ndarray:
    """``_products`` for every column of small whole weights: members x (weight, packed sums)."""
    b, count = digits.piece, digits.pieces
    parts, rest = [], z
    for _ in range(count):
        rest = rest * float(1 << b)
        parts.append(np.floor(rest))
        rest = rest - parts[-1]
    s = _settled([(w.T @ p).astype(np.int64) for p in parts], b)
    i, j = np.triu_indices(z.shape[1])
    levels = []
    for level in range(count):
        total = np.zeros((w.shape[1], len(i)))
        for k in range(level + 1):
            total += w.T @ (parts[k][:, i] * parts[level - k][:, j])
        levels.append(total.astype(np.int64))
    return np.concatenate([w.sum(0).astype(np.int64)[:, None], *s, *_settled(levels, b)], axis=1)


def collect_weighted(df: DataFrame, columns: list[str], weights: list[Column], prof: dict[str, dict] | None = None, at: tuple | None = None) -> list[Patterns]:
    """``collect`` for each of the given weights (whole numbers from 0 to 15), all from one scan, on the scale of the unweighted table or ``at``.

    A pattern's sums are one array with a line per weight, and one for the rows themselves.
    """
    prof = prof or profile(df, columns)
    mid, half = ends(prof, columns)
    weights = [F.lit(1), *weights]
    width, members = len(columns), len(weights)
    rows = 15 * max(prof[c]["rows"] for c in columns)
    digits = Digits.wide(rows)
    cells = df.select(*[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(columns)], *[w.cast("double").alias(f"_w{i}") for i, w in enumerate(weights)])
    schema = "mask string, node long, data binary"

    def carried(data: np.ndarray, p: int) -> np.ndarray:
        return np.stack([np.concatenate([line[:1], _carried(line[1:], p, digits)]) for line in data])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["mask", "node", "data"])

        for batch in batches:
            x = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)], 1)
            w = np.stack([batch.column(width + i).to_numpy(zero_copy_only=False).astype(float) for i in range(members)], 1)
            gone = np.isnan(x)
            key = np.unique(np.packbits(gone, axis=1), axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(key, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                for a in range(0, len(at), SLAB_ROWS // 16):
                    some = at[a : a + SLAB_ROWS // 16]
                    obs = ~gone[some[0]]
                    name = "".join("01"[int(g)] for g in gone[some[0]])
                    own = _weighted_products(((x - mid) / half)[some][:, obs], w[some], digits)
                    held[name] = carried(held[name] + own, int(obs.sum())) if name in held else own
            if sum(v.nbytes for v in held.values()) > HELD_BYTES:
                yield handed()
                held.clear()
        if held:
            yield handed()

    def added(table: pa.Table) -> pa.Table:
        pattern = table.column("mask")[0].as_py()
        data = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("data")).reshape(members, -1)
        return pa.table({"mask": [pattern], "node": pa.array([table.column("node")[0].as_py() // FAN], pa.int64()), "data": pa.array([carried(data, pattern.count("0")).tobytes()], pa.binary())})

    sums = cells.mapInArrow(run, schema)
    for _ in range(LEVELS):
        sums = sums.groupBy("mask", F.floor(F.col("node") / FAN)).applyInArrow(added, schema)
    found: dict[str, np.ndarray] = {}
    for r in sums.limit(MAX_PATTERNS * FAN + 1).collect():
        data = np.frombuffer(r["data"], np.int64).reshape(members, -1)
        found[r["mask"]] = found[r["mask"]] + data if r["mask"] in found else data
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} missingness patterns; drop sparse columns or group them")
    if at is None:
        mean, sd = _standard({((), m): [int(data[0, 0]), *_unpacked(m, data[0, 1:])] for m, data in found.items()}, prof, columns, half, digits)
        center, scale = mid + half * mean, half * sd
    else:
        center, scale = (np.asarray(v, float) for v in at)
        mean, sd = (center - mid) / half, scale / half
    parts = Parts(mean, sd, digits)
    out = []
    for i in range(1, members):
        blocks = {m: parts.standard(m, int(data[i, 0]), *_unpacked(m, data[i, 1:])) for m, data in sorted(found.items()) if data[i, 0]}
        out.append(Patterns(columns, center, scale, blocks))
    return out


def _unpacked(pattern: str, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sum high, sum low, product high, product low), the products as full matrices of the observed columns."""
    p = pattern.count("0")
    t = p * (p + 1) // 2
    at = np.triu_indices(p)

    def full(v: np.ndarray) -> np.ndarray:
        m = np.zeros((p, p), np.int64)
        m[at] = v
        m.T[at] = v
        return m

    return data[:p], data[p : 2 * p], full(data[2 * p : 2 * p + t]), full(data[2 * p + t :])


def _narrow_sums(df: DataFrame, columns: list[str], by: tuple[str, ...], mid: np.ndarray, half: np.ndarray, digits: Digits) -> DataFrame:
    """(by.., mask, n, s: high and low of each sum, q: likewise of the upper triangle of products), by column expressions."""
    (e, f), p = digits.s, len(columns)
    z = [(F.col(c) - F.lit(float(m))) / F.lit(float(h)) for c, m, h in zip(columns, mid, half, strict=True)]

    def cut(v: Column, name: str) -> list[Column]:
        up = v * F.lit(float(2**e))
        return [F.sum(F.floor(up)).alias(f"{name}h"), F.sum(F.floor((up - F.floor(up)) * F.lit(float(2**f)))).alias(f"{name}l")]

    aggs = [a for i in range(p) for a in cut(z[i], f"s{i}")] + [a for i in range(p) for j in range(i, p) for a in cut(z[i] * z[j], f"q{i}_{j}")]
    return df.groupBy(*by, mask(columns).alias("mask")).agg(F.count("*").alias("n"), *aggs)


def _collected(rows: DataFrame, columns: list[str], by: tuple[str, ...], wide: bool) -> dict[tuple, list]:
    """{(group.., pattern): [n, sum high, sum low, product high, product low]} of the observed columns."""
    most = MAX_PATTERNS * (1 if not by else 100)
    found: dict[tuple, list] = {}
    for r in rows.limit(most * (1 if not wide else FAN) + 1).collect():
        pattern = r["mask"]
        obs = [i for i, c in enumerate(pattern) if c == "0"]
        if wide:
            parts = _unpacked(pattern, np.frombuffer(r["data"], np.int64))
        else:
            at = [[f"q{min(i, j)}_{max(i, j)}" for j in obs] for i in obs]
            parts = tuple(np.array([r[f"s{i}{x}"] for i in obs], np.int64) for x in "hl") + tuple(np.array([[r[c + x] for c in line] for line in at], np.int64).reshape(len(obs), len(obs)) for x in "hl")
        key = (tuple(r[c] for c in by), pattern)
        own = found.get(key)
        found[key] = [r["n"], *parts] if own is None else [own[0] + r["n"], *[a + b for a, b in zip(own[1:], parts, strict=True)]]
    if len({pattern for _, pattern in found}) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} missingness patterns; drop sparse columns or group them")
    if len(found) > most:
        raise ValueError(f"more than {most} blocks of a group and a missingness pattern; drop sparse columns or take fewer groups")
    return found


def ends(prof: dict[str, dict], columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(middle, half range) of each column; infinite and missing columns are refused."""
    empty = [c for c in columns if not prof[c]["n"]]
    if empty:
        raise ValueError(f"no observed value in {', '.join(empty)}")
    lo, hi = (np.array([float(prof[c][k]) for c in columns]) for k in ("min", "max"))
    if not (np.isfinite(lo) & np.isfinite(hi)).all():
        raise ValueError(f"infinite or NaN values in {', '.join(c for c, a, b in zip(columns, lo, hi, strict=True) if not (math.isfinite(a) and math.isfinite(b)))}")
    half = hi / 2 - lo / 2
    return lo / 2 + hi / 2, np.where(half > 0, half, 1.0)


def _location(n: int, sh: int, sl: int, qh: int, ql: int, digits: Digits, flat: bool, half: float) -> tuple[float, float]:
    """Mean and standard deviation on the moved scale from a column's exact sums; without spread the scale is that of the data."""
    s, q = (sh << digits.s[1]) + sl, (qh << digits.q[1]) + ql
    es, eq = 1 << sum(digits.s), 1 << sum(digits.q)
    mean = s / (n * es) if n else 0.0
    if n < 2 or flat:
        return mean, 1 / half
    spread = (n * q * es * es - s * s * eq) / (n * (n - 1) * es * es * eq)
    return mean, math.sqrt(spread) if spread > 0 else 1 / half


def _standard(found: dict[tuple, list], prof: dict[str, dict], columns: list[str], half: np.ndarray, digits: Digits) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each column on the moved scale, from exact sums."""
    out = []
    for j, c in enumerate(columns):
        total = [0] * 5
        for (_, pattern), (n, sh, sl, qh, ql) in found.items():
            if pattern[j] == "0":
                i = pattern[:j].count("0")
                for k, v in enumerate((n, sh[i], sl[i], qh[i, i], ql[i, i])):
                    total[k] += int(v)
        out.append(_location(*total, digits, degenerate(prof[c]), float(half[j])))
    return tuple(np.array(v) for v in zip(*out, strict=True)) if out else (np.zeros(0), np.ones(0))


@dataclass(frozen=True)
class Parts:
    """How exact sums become blocks on the scale of (mean, sd), both on the moved scale of the sums."""

    mean: np.ndarray
    sd: np.ndarray
    digits: Digits

    def standard(self, pattern: str, n: int, sh: np.ndarray, sl: np.ndarray, qh: np.ndarray, ql: np.ndarray) -> Block:
        """Longer floats than doubles, so that moving the origin to the mean costs no digits."""
        (es, fs), (eq, fq) = self.digits.s, self.digits.q
        obs = np.array([i for i, c in enumerate(pattern) if c == "0"], int)
        s = (sh.astype(np.longdouble) + np.ldexp(sl.astype(np.longdouble), -fs)) * np.longdouble(2.0) ** -es
        q = (qh.astype(np.longdouble) + np.ldexp(ql.astype(np.longdouble), -fq)) * np.longdouble(2.0) ** -eq
        m, d = self.mean[obs].astype(np.longdouble), self.sd[obs].astype(np.longdouble)
        q = (q - np.outer(s, m) - np.outer(m, s) + n * np.outer(m, m)) / np.outer(d, d)
        return Block(obs, float(n), ((s - n * m) / d).astype(float), q.astype(float))

    def block(self, row: dict) -> Block:
        """From a row of ``wide_sums``."""
        return self.standard(row["mask"], row["n"], *_unpacked(row["mask"], np.frombuffer(row["data"], np.int64)))


def gathered(df: DataFrame, columns: list[str], most: int) -> Patterns | tuple[np.ndarray, np.ndarray, DataFrame, Parts]:
    """``Patterns`` if there are at most ``most``, else (center, scale, rows of ``wide_sums``, how they become blocks) with the rows persisted on the cluster.

    Rows that are lost with an executor are summed again, to the same bits.
    """
    if df.select(mask(columns).alias("m")).distinct().limit(most + 1).count() <= most:
        return collect(df, columns)
    prof = profile(df, columns)
    mid, half = ends(prof, columns)
    digits = Digits.wide(max(prof[c]["rows"] for c in columns))
    rows = wide_sums(df, columns, (), mid, half, digits).persist()
    mean, sd = np.zeros(len(columns)), np.ones(len(columns))
    cells = rows.mapInArrow(_diagonals(len(columns)), "j int, n long, sh long, sl long, qh long, ql long")
    sums = [F.sum(c).alias(c) for c in ("n", "sh", "sl")] + [F.sum(F.shiftright("qh", 32)).alias("qhh"), F.sum(F.col("qh").bitwiseAND(F.lit((1 << 32) - 1))).alias("qhl"), F.sum("ql").alias("ql")]
    for r in cells.groupBy("j").agg(*sums).collect():
        exact = (r["n"], r["sh"], r["sl"], (r["qhh"] << 32) + r["qhl"], r["ql"])
        mean[r["j"]], sd[r["j"]] = _location(*exact, digits, degenerate(prof[columns[r["j"]]]), half[r["j"]])
    return mid + half * mean, half * sd, rows, Parts(mean, sd, digits)


def grouped_blocks(df: DataFrame, columns: list[str], group: str, prof: dict[str, dict], at: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, Parts]:
    """(rows of a group's value and a pattern with exact sums, how ``numbers`` reads them): one aggregation, nothing is collected.

    ``at`` is the (center, scale) that blocks shall have.
    """
    mid, half = ends(prof, columns)
    wide = len(columns) > NARROW
    rows = max(prof[c]["rows"] for c in columns)
    digits = Digits.wide(rows) if wide else Digits.narrow(rows)
    named = df.filter(F.col(group).isNotNull())
    return (wide_sums if wide else _narrow_sums)(named, columns, (group,), mid, half, digits), Parts((at[0] - mid) / half, at[1] / half, digits)


def numbers(batch: pa.RecordBatch, width: int, parts: Parts) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pattern, places in the batch, n, s, q) of all rows of each pattern of a batch of ``grouped_blocks``."""
    pattern = np.array(batch.column("mask").to_pylist())
    (es, fs), (eq, fq) = parts.digits.s, parts.digits.q
    for m in np.unique(pattern):
        at = np.flatnonzero(pattern == m)
        obs = [i for i, c in enumerate(m) if c == "0"]
        n = batch.column("n").to_numpy()[at].astype(float)
        if "data" in batch.schema.names:
            data = [_unpacked(str(m), np.frombuffer(batch.column("data")[int(i)].as_py(), np.int64)) for i in at]
            sh, sl, qh, ql = (np.array([d[k] for d in data], np.int64) for k in range(4))
        else:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)[at].astype(np.int64)  # noqa: B023, E731
            sh, sl = (np.stack([get(f"s{i}{x}") for i in obs], 1) if obs else np.zeros((len(at), 0), np.int64) for x in "hl")
            qh, ql = (np.stack([np.stack([get(f"q{min(i, j)}_{max(i, j)}{x}") for j in obs], 1) for i in obs], 1) if obs else np.zeros((len(at), 0, 0), np.int64) for x in "hl")
        s = (sh.astype(np.longdouble) + np.ldexp(sl.astype(np.longdouble), -fs)) * np.longdouble(2.0) ** -es
        q = (qh.astype(np.longdouble) + np.ldexp(ql.astype(np.longdouble), -fq)) * np.longdouble(2.0) ** -eq
        mean, sd = parts.mean[obs].astype(np.longdouble), parts.sd[obs].astype(np.longdouble)
        q = (q - s[:, :, None] * mean - mean[:, None] * s[:, None] + n[:, None, None] * np.outer(mean, mean)) / np.outer(sd, sd)
        yield str(m), at, n, ((s - n[:, None] * mean) / sd).astype(float), q.astype(float)


def _diagonals(width: int):
    """Of each pattern's packed sums those of the single columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sh, sl, qh, ql = _unpacked(r["mask"], np.frombuffer(r["data"], np.int64))
                obs = [i for i, c in enumerate(r["mask"]) if c == "0"]
                out += [{"j": j, "n": r["n"], "sh": int(sh[i]), "sl": int(sl[i]), "qh": int(qh[i, i]), "ql": int(ql[i, i])} for i, j in enumerate(obs)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("j", pa.int32()), *[(c, pa.int64()) for c in ("n", "sh", "sl", "qh", "ql")]]))

    return run


def collect(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), prof: dict[str, dict] | None = None, at: tuple | None = None) -> Patterns | dict[tuple, Patterns]:
    """Standardised pattern statistics; with ``by`` one ``Patterns`` for each value of those columns.

    Two jobs: the profile (skipped if given) and one partial aggregation.  ``at``
    gives (center, scale) to use instead of the columns' means and standard deviations.
    """
    prof = prof or profile(df, columns)
    mid, half = ends(prof, columns)
    rows = max(prof[c]["rows"] for c in columns) if columns else 1
    wide = len(columns) > NARROW
    digits = Digits.wide(rows) if wide else Digits.narrow(rows)
    with compilable(df.sparkSession) if wide else nullcontext():
        found = _collected((wide_sums if wide else _narrow_sums)(df, columns, by, mid, half, digits), columns, by, wide)
    mean, sd = _standard(found, prof, columns, half, digits)
    if at is not None:
        mean, sd = (np.asarray(at[0], float) - mid) / half, np.asarray(at[1], float) / half
    center, scale = mid + half * mean, half * sd
    if at is not None:
        center, scale = (np.asarray(v, float) for v in at)
    parts = Parts(mean, sd, digits)
    out: dict[tuple, Patterns] = {}
    for (group, pattern), sums in sorted(found.items(), key=lambda x: x[0][1]):
        block = parts.standard(pattern, *sums)
        out.setdefault(group, Patterns(columns, center, scale, {})).blocks[pattern] = block
    if by:
        return out
    return out.get((), Patterns(columns, center, scale, {}))
