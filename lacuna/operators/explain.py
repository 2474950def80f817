"""Explanations of fitted models: Shapley values of features and of observing them.

A feature outside a coalition is NULL, so the model itself integrates over it.
All variants of a row are rows of one table: the model runs once over them.  Its
values for a row are then one array over the lattice of coalitions, and Shapley
values are weighted differences along its axes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions import exprs
from lacuna.functions.checks import check_choice
from lacuna.plans import gaussian

#: Features up to which all coalitions are evaluated, and coalitions sampled beyond.
EXACT = 15
MASKS = 512


def output(model, kind: str = "auto", value=None) -> tuple[str, Column]:
    """(kind, column) that a model's ``transform`` is explained by.

    auto: the probability of ``value`` (the last class) for classes, else the
    prediction; proba, log-odds and raw choose one.
    """
    check_choice(kind, ("auto", "proba", "log-odds", "raw"), "output", "explainer")
    classes = getattr(model, "classes", None)
    if kind == "auto":
        kind = "proba" if classes else "raw"
    if kind == "raw":
        return kind, F.col("prediction").cast("double")
    if not classes:
        raise ValueError("explainer: a regression has no class probabilities")
    if value is not None and value not in classes:
        raise ValueError(f"explainer: {value!r} is not a class")
    p = F.col("probabilities")[classes.index(value) if value is not None else len(classes) - 1]
    if kind == "proba":
        return kind, p
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return kind, F.log(p / (1 - p))


#: Names that a user's columns do not have.
MASK, ROW, OWN, SEEN = "__lattice_mask", "__lattice_row", "__lattice_key", "__lattice_seen"


def _rowwise(model) -> bool:
    """Whether ``transform`` works on each row by itself, so that rows keep their order."""
    if hasattr(model, "model"):
        return _rowwise(model.model)
    if getattr(model, "scores", None) is not None and not model.scores.rowwise:
        return False
    return all(_rowwise(m) for m in model.models if m is not None) if hasattr(model, "models") else getattr(model, "rowwise", False)


def _values(df: DataFrame, key: str, features: list[str], masks: np.ndarray, out: Column, model) -> DataFrame:
    """(key, seen, values): the model's outputs with only each mask's features known, in the masks' order; seen has a bit for each feature of the row.

    The variants of a row follow each other, and row by row models leave them so:
    they are gathered where they are.  Only models that join move them.
    """
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << j)).otherwise(0).cast("long") for j, c in enumerate(features)]
    seen = sum(bits[1:], bits[0])
    inside = lambda j: F.shiftright(F.element_at(order, F.col(MASK) + 1), j).bitwiseAND(F.lit(1)) == 1
    order = F.array(*[F.lit(int(m)).cast("long") for m in masks]) if len(masks) < 1 << len(features) else None
    rows = df.withColumn(SEEN, seen).withColumn(MASK, F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
    if order is None:
        inside = lambda j: F.shiftright(F.col(MASK), j).bitwiseAND(F.lit(1)) == 1
    rows = rows.withColumns({c: F.when(inside(j), F.col(c)) for j, c in enumerate(features)})
    if key in _keys(model):
        rows = rows.withColumn(OWN, F.col(key)).withColumn(key, F.concat_ws("/", F.col(key).cast("string"), F.col(MASK).cast("string")))
    else:
        rows = rows.withColumn(OWN, F.col(key))
    got = model.transform(rows).select(F.col(OWN).alias("key"), F.col(SEEN).alias("seen"), F.col(MASK).alias("at"), out.cast("double").alias("value"))
    if not _rowwise(model):
        held = got.groupBy("key", "seen").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_v"))  # as many as masks
        return held.select("key", "seen", F.col("_v.value").alias("values"))
    size = len(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                table = pa.Table.from_batches(held).combine_chunks()
                whole = n // size * size
                if (table.column("at").to_numpy()[:whole].reshape(-1, size) != np.arange(size)).any():
                    raise ValueError("the variants of a row came in another order")
                first = pa.array(np.arange(0, whole, size))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(whole // size + 1) * size, pa.int32()), table.column("value").combine_chunks()[:whole])
                yield pa.RecordBatch.from_arrays([table.column(c).take(first).combine_chunks() for c in ("key", "seen")] + [lists], names=["key", "seen", "values"])
                held, n = table.slice(whole).to_batches(), n - whole
        if n:
            raise ValueError("a row lacks variants")

    return got.mapInArrow(run, f"key {got.schema['key'].dataType.simpleString()}, seen long, values array<double>")


def lattice(values: np.ndarray, p: int) -> np.ndarray:
    """Shapley values (rows x p) from the values of all coalitions (rows x 2^p, bit j of the place for feature j)."""
    size = np.bitwise_count(np.arange(1 << p))
    weight = np.array([math.factorial(n) * math.factorial(p - n - 1) / math.factorial(p) for n in range(p)] + [0.0])
    out = np.empty((len(values), p))
    for j in range(p):
        axis = (1 << (p - 1 - j), 2, 1 << j)
        cut = values.reshape(len(values), *axis)
        w = weight[size.reshape(axis)[:, 0]]
        out[:, j] = np.einsum("rab,ab->r", cut[:, :, 1] - cut[:, :, 0], w)
    return out


def _long(values: DataFrame, key: str, features: list[str], solve) -> DataFrame:
    """(key, feature, phi) of arrays of values; ``solve(values, seen)`` gives rows x features; what a row lacks gets 0."""
    p = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max(1, (1 << 22) // max(1, len(batch.column("values")[0]) if batch.num_rows else 1))
            for a in range(0, batch.num_rows, width):
                some = batch.slice(a, width)
                v = some.column("values").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(some.num_rows, -1)
                seen = (some.column("seen").to_numpy()[:, None] >> np.arange(p) & 1).astype(bool)
                phi = np.where(seen, solve(v, seen), 0.0)
                names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(p), len(v)), pa.int32()), pa.array(features)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(np.repeat(np.arange(len(v)), p))), names, pa.array(phi.ravel())], [key, "feature", "phi"])

    return values.mapInArrow(run, f"`{key}` {values.schema['key'].dataType.simpleString()}, feature string, phi double")


def _keys(model) -> set[str]:
    return {m.key for m in getattr(model, "models", [model]) if hasattr(m, "key")}


def baseline(model, df: DataFrame, features: list[str], kind: str = "auto", value=None) -> float:
    """The output for a row in which nothing is observed."""
    row = df.limit(1).withColumns({c: F.lit(None).cast("double") for c in features})
    return float(model.transform(row).select(output(model, kind, value)[1].alias("v")).first()["v"])


def exact(model, df: DataFrame, key: str, features: list[str], kind: str = "auto", value=None) -> DataFrame:
    """(key, feature, phi): exact Shapley values; a feature that the row lacks gets 0."""
    p = len(features)
    if p > EXACT:
        raise ValueError(f"exact Shapley values take at most {EXACT} features")
    values = _values(df, key, features, np.arange(1 << p), output(model, kind, value)[1], model)
    return _long(values, key, features, lambda v, seen: lattice(v, p))


def coalitions(p: int, count: int = MASKS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of the kernel estimate: sizes uniform in 1..p-1, the features of a size at random."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, p, count)
    z = np.zeros((count, p), bool)
    for i, s in enumerate(sizes):
        z[i, rng.permutation(p)[:s]] = True
    return z, (p - 1) / (sizes * (p - sizes))


def sampled(model, df: DataFrame, key: str, features: list[str], kind: str = "auto", value=None, count: int = MASKS, seed: int = 0) -> DataFrame:
    """(key, feature, phi) by a weighted regression on sampled coalitions, shifted so that the values sum to output minus baseline.

    A feature that the row lacks gets 0 and its share goes to the others.
    """
    p = len(features)
    if p < 2:
        return exact(model, df, key, features, kind, value)
    if p > 62:
        raise ValueError("sampled Shapley values take at most 62 features")
    z, w = coalitions(p, count, seed)
    masks = z @ (1 << np.arange(p, dtype=np.int64))
    full = (1 << p) - 1
    wanted = np.unique(np.concatenate([masks, [0, full]]))
    place = np.searchsorted(wanted, masks)
    values = _values(df, key, features, wanted, output(model, kind, value)[1], model)

    def solve(v: np.ndarray, seen: np.ndarray) -> np.ndarray:
        phi = np.zeros(seen.shape)
        known: dict[bytes, tuple] = {}
        for i, on in enumerate(seen):
            if on.any():
                if on.tobytes() not in known:
                    x = z[:, on].astype(float)
                    gram = np.linalg.inv((x * w[:, None]).T @ x + 1e-8 * np.eye(on.sum()))
                    known[on.tobytes()] = gram @ (x * w[:, None]).T, gram.sum(1)
                fit_, u = known[on.tobytes()]
                own = fit_ @ (v[i, place] - v[i, 0])
                phi[i, on] = own + u * (v[i, -1] - v[i, 0] - own.sum()) / u.sum()
        return phi

    return _long(values, key, features, solve)


@dataclass
class Explainer:
    """A model with the moments that stand in for features it has not seen."""

    model: object
    features: list[str]
    kind: str
    value: object
    expected: float
    mu: np.ndarray
    sigma: np.ndarray

    def shap(self, df: DataFrame, key: str, method: str = "auto") -> DataFrame:
        """(key, feature, phi): exact up to ``EXACT`` features, else sampled."""
        check_choice(method, ("auto", "exact", "kernel"), "method", "explainer")
        run = exact if method == "exact" or method == "auto" and len(self.features) <= EXACT else sampled
        return run(self.model, df, key, self.features, self.kind, self.value)

    def missing(self, df: DataFrame, key: str) -> DataFrame:
        """(key, feature, phi): output with the feature known, or at its conditional mean, minus output without it."""
        out = output(self.model, self.kind, self.value)[1]
        masks = [r["m"] for r in df.select(exprs.mask(self.features).alias("m")).distinct().collect()]
        means = {f"_known_{c}": gaussian.conditional_mean(self.features, self.mu, self.sigma, j, masks) for j, c in enumerate(self.features)}
        rows = df.withColumns(means).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(2 * len(self.features) - 1))))
        rows = rows.withColumns({c: F.when(F.floor(F.col("_at") / 2) != j, F.col(c)).when(F.col("_at") % 2 == 0, F.col(f"_known_{c}")) for j, c in enumerate(self.features)})
        own = key in _keys(self.model)
        if own:
            rows = rows.withColumn("_own", F.col(key)).withColumn(key, F.concat_ws("/", F.col(key).cast("string"), F.col("_at").cast("string")))
        got = self.model.transform(rows).select(F.col("_own" if own else key).alias(key), F.floor(F.col("_at") / 2).alias("_j"), F.when(F.col("_at") % 2 == 0, out).otherwise(-out).alias("_v"))
        name = F.element_at(F.array(*[F.lit(c) for c in self.features]), (F.col("_j") + 1).cast("int"))
        return got.groupBy(key, "_j").agg(F.sum("_v").alias("phi")).select(key, name.alias("feature"), "phi")


def fit(model, df: DataFrame, features: list[str], kind: str = "auto", value=None) -> Explainer:
    mu, sigma = gaussian.raw_moments(*gaussian.moments(df, features, 1000, 1e-12, 1e-10, settle=True))
    return Explainer(model, features, kind, value, baseline(model, df, features, kind, value), mu, sigma)


def summary(values: DataFrame) -> DataFrame:
    """(feature, mean_abs): mean |phi| of each feature."""
    return values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def export(values: DataFrame, df: DataFrame, key: str, features: list[str], expected: float) -> DataFrame:
    """(key, feature, phi, value, base): everything that plotting tools ask for, in long form."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    long = df.select(F.col(key).alias("_k"), F.explode(cells).alias("_c")).select("_k", F.col("_c.feature").alias("_f"), F.col("_c.value").alias("value"))
    return values.join(long, (F.col(key) == F.col("_k")) & (F.col("feature") == F.col("_f"))).select(key, "feature", "phi", "value", F.lit(float(expected)).alias("base"))


def beeswarm(values: DataFrame, key: str, bins: int = 40, spread: float = 0.35, most: int = 20) -> DataFrame:
    """(key, feature, phi, place, jitter): points of the ``most`` weightiest features; those of a bin stand apart around 0."""
    top = summary(values).orderBy(F.desc("mean_abs"), "feature").limit(most)  # one row per feature
    top = top.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean_abs"), "feature"))).select(F.col("feature").alias("_f"), "place")
    range_ = values.agg(F.min("phi").alias("lo"), F.max("phi").alias("hi")).first()
    lo, width = range_["lo"] or 0.0, ((range_["hi"] or 0.0) - (range_["lo"] or 0.0)) or 1.0
    rows = values.join(F.broadcast(top), F.col("feature") == F.col("_f")).withColumn("_bin", F.least(F.floor((F.col("phi") - lo) / width * bins), F.lit(bins - 1)))
    # a point's height is a fixed function of its key; only its bin's size is counted
    sizes = rows.groupBy("feature", "_bin").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy("feature").agg(F.max("_n").alias("_m"))
    sizes = sizes.join(largest, "feature").select(F.col("feature").alias("_g"), F.col("_bin").alias("_b"), (F.col("_n") / F.col("_m")).alias("_share"))
    u = (F.pmod(F.xxhash64(F.col(key), F.col("feature")), F.lit(1 << 20)) + 0.5) / float(1 << 20) * 2 - 1
    return rows.join(sizes, (F.col("feature") == F.col("_g")) & (F.col("_bin") == F.col("_b"))).select(key, "feature", "phi", "place", (u * spread * F.col("_share")).alias("jitter"))


def missing_importance(values: DataFrame) -> DataFrame:
    """(feature, mean, mean_abs, place): what not observing each feature costs, weightiest first."""
    t = values.groupBy("feature").agg(F.avg("phi").alias("mean"), F.avg(F.abs("phi")).alias("mean_abs"))
    return t.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean_abs"), "feature")))  # one row per feature


def waterfall(values: DataFrame, key: str, row, expected: float, most: int = 12) -> DataFrame:
    """(place, feature, phi, start, end) of one row's bars from the baseline up; features beyond ``most`` are one bar."""
    one = values.filter(F.col(key) == F.lit(row)).withColumn("_r", F.row_number().over(W.orderBy(F.desc(F.abs("phi")), "feature")))  # one row per feature
    name = F.when(F.col("_r") < most, F.col("feature")).otherwise(F.lit("others"))
    bars = one.groupBy(name.alias("feature")).agg(F.sum("phi").alias("phi"), F.min("_r").alias("place"))
    end = F.lit(float(expected)) + F.sum("phi").over(W.orderBy(F.desc("place")))
    return bars.withColumn("end", end).withColumn("start", F.col("end") - F.col("phi")).select("place", "feature", "phi", "start", "end")


def dependence(values: DataFrame, df: DataFrame, key: str, feature: str, interaction: str | None = None) -> DataFrame:
    """(key, value, phi, other): a feature's values against its phi, coloured by another feature."""
    other = F.col(interaction) if interaction else F.lit(None).cast("double")
    own = df.select(F.col(key).alias("_k"), F.col(feature).alias("value"), other.alias("other"))
    return values.filter(F.col("feature") == feature).join(own, F.col(key) == F.col("_k")).filter("value IS NOT NULL").select(key, "value", "phi", "other")
