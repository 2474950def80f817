"""Nearest neighbours and kernels over expected distances.

A row with missing cells has an expected position and a variance left over, so
the expected squared distance of two rows is ``|F - G|^2 + s + t``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions import exprs
from lacuna.plans import gaussian, pivots

def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(center, scale, mu, sigma): EM moments on the standardised scale."""
    p, m = gaussian.moments(df, columns, 100, 1e-5, 1e-6)
    return p.center, p.scale, m.mu, m.sigma


def expected(df: DataFrame, columns: list[str], keep: tuple[str, ...], center, scale, mu, sigma) -> DataFrame:
    """keep.., f0.., s: the expected standardised row and its summed conditional variances."""
    masks = gaussian.all_masks(len(columns)) if len(columns) <= 6 else [r["m"] for r in df.select(exprs.mask(columns).alias("m")).distinct().collect()]
    z = df.select(*keep, *[((F.col(c) - F.lit(float(a))) / F.lit(float(b))).alias(c) for c, a, b in zip(columns, center, scale, strict=True)])

    def left(obs: list[int], mis: list[int]) -> tuple[float, np.ndarray]:
        return (float(np.trace(gaussian.conditional(mu, sigma, np.array(obs, int), np.array(mis, int))[2])) if mis else 0.0), np.zeros(len(obs))

    cells = [gaussian.conditional_mean(columns, mu, sigma, j, masks).alias(f"f{j}") for j in range(len(columns))]
    return z.select(*keep, *cells, gaussian.affine(columns, masks, left).alias("s"))


def nearest(train: DataFrame, queries: DataFrame, key: str, query_key: str, width: int, k: int, digits: int = 9) -> DataFrame:
    """(query, key, d, rank): the k nearest rows of ``train`` for each query, distances rounded to ``digits`` and ties to the smaller key.

    Both sides come from ``expected``.  Training rows lie in cells around pivots,
    and a query meets only the cells that may hold one of its k nearest.
    """
    found = pivots.join(train, queries, key, query_key, width, k, digits)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("d", key))).filter(F.col("rank") <= k)


def predict(found: DataFrame, labels: DataFrame, key: str, y: str, weights: str = "distance") -> DataFrame:
    """(query, prediction, sd): weighted mean of the neighbours' outcomes; exact matches take all, missing outcomes keep their place but no weight."""
    if weights not in ("distance", "uniform"):
        raise ValueError("weights must be 'distance' or 'uniform'")
    rows = found.join(labels.select(key, y).hint("merge"), key).filter(F.col(y).isNotNull())
    of = W.partitionBy("query")
    exact = F.max((F.col("d") == 0).cast("int")).over(of) == 1
    w = F.lit(1.0) if weights == "uniform" else F.when(exact, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    t = rows.withColumn("w", w).groupBy("query").agg((F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("prediction"), F.sum("w").alias("_w"), F.sum(F.col("w") * F.col(y) * F.col(y)).alias("_q"))
    return t.select("query", "prediction", F.sqrt(F.greatest(F.col("_q") / F.col("_w") - F.col("prediction") * F.col("prediction"), F.lit(0.0))).alias("sd"))


def class_shares(found: DataFrame, labels: DataFrame, key: str, y: str) -> DataFrame:
    """(query, class, share): distance-weighted class shares of the neighbours."""
    rows = found.join(labels.select(key, F.col(y).alias("class")).hint("merge"), key).filter(F.col("class").isNotNull())
    of = W.partitionBy("query")
    exact = F.max((F.col("d") == 0).cast("int")).over(of) == 1
    rows = rows.withColumn("w", F.when(exact, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d")))
    t = rows.groupBy("query", "class").agg(F.sum("w").alias("w"))
    return t.withColumn("share", F.col("w") / F.sum("w").over(of)).drop("w")


def rbf(d2: Column, gamma: float) -> Column:
    return F.exp(-gamma * d2)


#: Rows of a side that meet in one task: about the first, in up to so many parts a side, and never more than about the last, which Spark's product keeps in memory.
PAIR_ROWS, PAIR_PARTS, MOST_PAIR_ROWS = 512, 45, 4096
#: Keys of equal rows that are gathered in one list, about, and in a row of their own at most.
MOST_KEYS, CHUNK_KEYS = 65_536, 512


def _crossed(rows: DataFrame, by: list[str], parts: int) -> DataFrame:
    """(columns.., other_columns..): all pairs of rows. A row is shuffled once; each task reads one part of either side, and none is broadcast."""
    dealt = rows.repartition(parts, *by)
    return dealt.crossJoin(dealt.select(*[F.col(c).alias(f"other_{c}") for c in rows.columns]).hint("shuffle_replicate_nl"))


def _parts(n: int, rows: int) -> int:
    return max(1, min(PAIR_PARTS, math.ceil(n / PAIR_ROWS)), math.ceil(rows / MOST_PAIR_ROWS))


def paired(rows: DataFrame, key: str) -> DataFrame:
    """(a, b, columns.., other_columns..): every pair of a set of rows, in tasks of two parts of the rows."""
    n = rows.count()
    return _crossed(rows, [key], _parts(n, n)).withColumnsRenamed({key: "a", f"other_{key}": "b"})


def over_pairs(rows: DataFrame, key: str, columns: dict[str, Column], limit: int | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, columns..): functions of x and other_x, the columns besides the key, for every pair of rows; refused only beyond a given ``limit``.

    With ``digits`` values, from 0 to 1, are rounded.  Rows that are equal but for their key are gathered, so that the functions
    are evaluated once for a pair of such sets (of up to ``CHUNK_KEYS`` rows).
    """
    own = [c for c in rows.columns if c != key]
    size = rows.groupBy(*own).count().agg(F.count("*").alias("kinds"), F.sum("count").alias("n"), F.max("count").alias("most")).first()
    n = size["n"] or 0
    if limit is not None and n > limit:
        raise ValueError(f"a Gram matrix of more than {limit} rows is refused")
    width = max(1, min(CHUNK_KEYS, n // (8 * _parts(n, 1))))  # several chunks a part, so that the parts are alike
    lists = max(1, math.ceil((size["most"] or 0) / MOST_KEYS))
    sets = rows.groupBy(*own, F.pmod(F.xxhash64(key), F.lit(lists)).alias("_list")).agg(F.sort_array(F.collect_list(F.struct(key))).alias("_keys"))
    keys = F.transform("_keys", lambda s: s[key])
    at = F.explode(F.sequence(F.lit(1), F.size("_keys"), F.lit(width))).alias("_at")
    chunks = sets.select(*own, "_list", at, keys.alias("_keys")).select(*own, "_list", "_at", F.slice("_keys", F.col("_at"), F.lit(width)).alias("_keys"))
    pairs = _crossed(chunks, [*own, "_list", "_at"], _parts(n, size["kinds"] * lists + n // width))
    pairs = pairs.select("_keys", "other__keys", *[c.alias(name) for name, c in columns.items()])
    if digits is not None:
        pairs = pairs.withColumns({c: rounded(F.col(c), digits) for c in columns})
    return pairs.select(F.explode("_keys").alias("a"), "other__keys", *columns).select("a", F.explode("other__keys").alias("b"), *columns)


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of numbers from 0 to 1, which takes its slow way over decimals only near a tie (and for NaN)."""
    up = x * 10.0**digits
    off = F.abs(up - F.floor(up) - 0.5)
    return F.when(off.between(1e-4, 0.5), F.floor(up + 0.5) / 10.0**digits).otherwise(F.round(x, digits))


def gram(rows: DataFrame, key: str, width: int, gamma: float, limit: int | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, k): the expected RBF kernel of all pairs of rows, if asked rounded; the self-diagonal is 1."""
    d2 = F.col("s") + F.col("other_s")
    for j in range(width):
        gap = F.col(f"f{j}") - F.col(f"other_f{j}")
        d2 = d2 + gap * gap
    pairs = over_pairs(rows.select(key, *[f"f{j}" for j in range(width)], "s"), key, {"k": rbf(d2, gamma)}, limit, digits)
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("k")).alias("k"))


def kernel_1d(r: Column, kernel: str) -> Column:
    """rbf, matern52 or matern12 of a scaled distance."""
    a = F.abs(r)
    if kernel == "rbf":
        return F.exp(-0.5 * r * r)
    if kernel == "matern52":
        return (1 + math.sqrt(5) * a + 5 * a * a / 3) * F.exp(-math.sqrt(5) * a)
    if kernel == "matern12":
        return F.exp(-a)
    raise ValueError("kernel must be rbf, matern52 or matern12")
