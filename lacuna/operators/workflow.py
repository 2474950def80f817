"""Missingness injection, baseline arms, copula positions, sensitivity, explanation, recommendation."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans.ranks import ranked


def plot_positions(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, u): Blom positions (r - 0.375) / (n + 0.25), averaged over ties; NULL stays; fewer than three distinct values pass through."""
    c = ranked(df, column)
    t = c.agg(F.sum("c").alias("_n"), F.count("*").alias("_d")).first()
    u = (F.col("rank") - 0.375) / F.lit((t["_n"] or 0) + 0.25) if t["_d"] >= 3 else F.col("v")
    c = c.select("v", u.cast("double").alias("u"))
    return df.select(key, column).join(c, F.col(column) == F.col("v"), "left").select(key, "u")


def standardise(df: DataFrame, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    """(x - mean) / sd of the observed values, from one aggregation."""
    t = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    return df.select(*keep, *[((F.col(c) - F.lit(t[f"m_{c}"])) / F.lit(t[f"s_{c}"] or 1.0)).alias(c) for c in columns])


def inject(df: DataFrame, column: str, chance: Column, draw: Column) -> DataFrame:
    """NULLs the column where ``draw`` (uniform in [0, 1)) is below ``chance``."""
    return df.withColumn(column, F.when(~(draw < chance), F.col(column)))


def inject_mcar(df: DataFrame, column: str, rate: float, draw: Column) -> DataFrame:
    return inject(df, column, F.lit(rate), draw)


def inject_by_median(df: DataFrame, column: str, by: str, rate: float, draw: Column) -> DataFrame:
    """Missing at random (``by`` another column) or not at random (``by`` the column itself): 4/3 of the rate above the median of ``by``, 2/3 below."""
    middle = df.agg(F.percentile(by, 0.5)).first()[0]
    return inject(df, column, F.when(F.col(by) > F.lit(float(middle)), 4 / 3 * rate).otherwise(2 / 3 * rate), draw)


def drop_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def complete_columns(df: DataFrame, columns: list[str]) -> list[str]:
    t = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if t[c] == t["_n"]]


def fill_means(df: DataFrame, columns: list[str]) -> DataFrame:
    t = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(t[c])) for c in columns})


def crossover(scores: DataFrame) -> DataFrame:
    """(dataset, rate): the lowest missing rate at which ``ours`` beats ``baseline``; NULL if never."""
    return scores.groupBy("dataset").agg(F.min(F.when(F.col("ours") > F.col("baseline"), F.col("rate"))).alias("rate"))


def blups(df: DataFrame, y: str, group: str, mean: float, tau2: float, sigma2: float) -> DataFrame:
    """(group, n, blup): best linear predictions of random intercepts at given variance components."""
    g = df.filter(F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(y) - F.lit(mean)).alias("r"))
    return g.select(group, "n", (tau2 * F.col("r") / (sigma2 + F.col("n") * tau2)).alias("blup"))


def add_blups(df: DataFrame, table: DataFrame, group: str, fixed: Column) -> DataFrame:
    """Adds prediction = fixed part + the group's intercept, 0 for a group never seen."""
    b = table.select(F.col(group).alias("_g"), "blup")
    return df.join(b, F.col(group) == F.col("_g"), "left").withColumn("prediction", fixed + F.coalesce("blup", F.lit(0.0))).drop("_g", "blup")


def tipping_point(curve: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(feature, delta, verdict): the smallest shift |delta| at which a coefficient changes sides of the threshold.

    curve: (feature, delta_std, coef) with the row delta_std = 0.
    """
    at0 = curve.filter("delta_std = 0").select(F.col("feature").alias("_f"), F.col("coef").alias("_c"))
    flips = F.signum(F.col("coef") - threshold) != F.signum(F.col("_c") - threshold)
    t = curve.join(at0, F.col("feature") == F.col("_f")).groupBy("feature").agg(F.min(F.when(flips, F.abs("delta_std"))).alias("delta"))
    verdict = F.when(F.col("delta").isNull() | (F.col("delta") >= 1), "ROBUST").when(F.col("delta") >= 0.5, "MILD").otherwise("SENSITIVE")
    return t.withColumn("verdict", verdict)


def exact_shapley(df: DataFrame, features: list[str], value, keep: tuple[str, ...]) -> DataFrame:
    """keep.., phi_<feature>: exact Shapley values of ``value``, a function of a {feature: column} mapping.

    All coalitions are expressions over one row (a feature outside is NULL), so
    one scan computes everything; features missing in the row get 0.
    """
    p = len(features)
    if p > 12:
        raise ValueError("exact Shapley values take at most 12 features")
    null = F.lit(None).cast("double")
    cells = {s: value({f: F.col(f) if f in s else null for f in features}).alias("v_" + "_".join(s)) for n in range(p + 1) for s in combinations(features, n)}
    rows = df.select(*keep, *features, *cells.values())
    out = []
    for f in features:
        total = F.lit(0.0)
        for s in cells:
            if f not in s:
                joined = tuple(x for x in features if x in s or x == f)
                weight = math.factorial(len(s)) * math.factorial(p - len(s) - 1) / math.factorial(p)
                total = total + F.lit(weight) * (F.col("v_" + "_".join(joined)) - F.col("v_" + "_".join(s)))
        out.append(F.when(F.col(f).isNotNull(), total).otherwise(0.0).alias(f"phi_{f}"))
    return rows.select(*keep, *out)


def shap_summary(values: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs): mean |phi| of each feature."""
    row = values.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs")) for f in features])
    return row.select(F.explode(cells).alias("c")).select("c.*")
