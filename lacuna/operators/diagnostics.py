"""Validation, profiles and tests of the missingness mechanism."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.exprs import mask
from lacuna.functions.numerics import chi2_sf, two_sided_p
from lacuna.plans.patterns import collect
from lacuna.plans.ranks import ranked


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def long_form(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep.., feature, value): one row per cell, in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.feature", "_c.value")


def pattern_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """pattern, n, pct and the missing columns of each missingness pattern, most frequent first."""
    names = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    rows = df.groupBy(mask(columns).alias("pattern"), F.array_join(names, ",").alias("missing_cols")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 4))
    return rows.orderBy(F.desc("n"), "pattern")


def missingness_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, complete and partial rows, and the missing count and rate of every column."""
    any_ = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
    aggs = [F.count("*").alias("n"), F.count(F.when(~any_, 1)).alias("n_complete"), F.count(F.when(any_, 1)).alias("n_partial")]
    for c in columns:
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}"), F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"rate_{c}")]
    return df.agg(*aggs)


def column_profile(df: DataFrame, columns: list[str], rtol: float = 1e-12) -> DataFrame:
    """Observed count, range, spread, scale and the constant and degenerate flags of every column."""
    rows = long_form(df, columns).groupBy("feature").agg(
        F.count("*").alias("n"), F.count("value").alias("n_obs"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.stddev_samp("value").alias("sd"), F.max(F.abs("value")).alias("top"),
    )
    constant = (F.col("n_obs") < 2) | (F.col("hi") == F.col("lo"))
    flat = constant | (F.coalesce("sd", F.lit(0.0)) <= 0) | (F.col("sd") <= rtol * F.col("top"))
    return rows.select(
        "feature", "n", "n_obs", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round("sd", 4).alias("sd"),
        F.coalesce(constant, F.lit(True)).alias("constant"), F.coalesce(flat, F.lit(True)).alias("degenerate"),
        F.round(F.when(F.coalesce(flat, F.lit(True)), F.lit(1.0)).otherwise(F.col("sd")), 4).alias("scale"),
    )


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Biased skewness and excess kurtosis of the observed values, and whether they call for a copula."""
    rows = long_form(df, columns).groupBy("feature").agg(
        F.count("value").alias("n_obs"), F.count_distinct("value").alias("n_distinct"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt")
    )
    heavy = (F.abs("skew") > 1) | (F.abs("kurt") > 2)
    return rows.select("feature", "n_obs", "n_distinct", F.round("skew", 4).alias("skew"), F.round("kurt", 4).alias("kurt"),
                       ((F.col("n_obs") >= 8) & (F.col("n_distinct") >= 3) & heavy).alias("needs_copula"))


def needs_copula(df: DataFrame, columns: list[str]) -> bool:
    return not moments(df, columns).filter("needs_copula").isEmpty()


def prefit_report(df: DataFrame, features: list[str], label: str, categorical: int = 10, missing: float = 0.7, ratio: float = 1000.0, tails: float = 7.0) -> DataFrame:
    """(level, column, code): the findings a fit should know of, from one aggregation.

    Errors: no observed value, infinite values, a constant column, no label.
    Warnings: few values (categorical), mostly missing, tiny spread, fewer
    labelled rows than features, spreads far apart.  Notes: binary, heavy tails,
    missing labels.
    """
    every = [*features, label]
    aggs = [F.count("*").alias("n")]
    for c in every:
        x = F.col(c)
        aggs += [F.count(x).alias(f"n_{c}"), F.count_distinct(x).alias(f"d_{c}"), F.stddev_samp(x).alias(f"s_{c}"), F.kurtosis(x).alias(f"k_{c}"),
                 F.count(F.when(F.abs(x) == F.lit(float("inf")), 1)).alias(f"i_{c}"), F.count(F.when(x != F.floor(x), 1)).alias(f"f_{c}")]
    t = df.agg(*aggs)
    rules: list[tuple[str, str, str, Column]] = []
    for c in features:
        n, d, s = F.col(f"n_{c}"), F.col(f"d_{c}"), F.col(f"s_{c}")
        rules += [
            ("error", c, "all_missing", n == 0),
            ("error", c, "infinite", F.col(f"i_{c}") > 0),
            ("error", c, "constant", (n > 0) & (d == 1)),
            ("note", c, "binary", d == 2),
            ("warning", c, "categorical", (d > 2) & (d <= categorical) & (F.col(f"f_{c}") == 0)),
            ("warning", c, "mostly_missing", 1 - n / F.col("n") > missing),
            ("warning", c, "tiny_spread", (d > 1) & (s < 1e-6)),
            ("note", c, "heavy_tails", F.abs(F.col(f"k_{c}")) > tails),
        ]
    spreads = [F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")) for c in features]
    wide = F.greatest(*spreads) / F.least(*spreads) if len(features) > 1 else F.lit(1.0)
    n = F.col(f"n_{label}")
    rules += [
        ("error", label, "all_missing", n == 0),
        ("error", label, "infinite", F.col(f"i_{label}") > 0),
        ("note", label, "missing_label", (n > 0) & (n < F.col("n"))),
        ("warning", "*", "few_rows", n < len(features)),
        ("warning", "*", "scales_apart", wide > ratio),
    ]
    found = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(a).alias("level"), F.lit(b).alias("column"), F.lit(c).alias("code"))) for a, b, c, when in rules])
    return t.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.level", "f.column", "f.code")


def label_encode(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, code): sorted distinct labels from 0, an absent label stays absent.

    The distinct labels are ranked on their own and joined back, so that no
    window runs over the rows.
    """
    codes = df.select(F.col(label).alias("_label")).filter("_label IS NOT NULL").distinct()
    codes = codes.withColumn("code", (F.row_number().over(W.orderBy("_label")) - 1).cast("int"))
    return df.select(key, F.col(label).alias("label")).join(codes, F.col("label") == F.col("_label"), "left").drop("_label")


def onehot(df: DataFrame, column: str, categories: list, keep: tuple[str, ...] = (), drop_first: bool = True) -> DataFrame:
    """Dummy columns: NULL where the value is missing, all 0 for a value not among ``categories``."""
    x = F.col(column)
    return df.select(*keep, *[F.when(x.isNotNull(), (x == c).cast("double")).alias(f"{column}_{c}") for c in categories[1 if drop_first else 0 :]])


def categories(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """The sorted distinct values of a categorical column; more than ``limit`` are refused."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; it is not categorical")
    return sorted(found)


def pairwise_cov(df: DataFrame, columns: list[str], min_pairs: int = 0) -> DataFrame:
    """(a, b, n, cov): available-case covariances; with ``min_pairs`` an off-diagonal entry with fewer pairs is 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = []
    for a, b in pairs:
        aggs += [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n_{a}_{b}"), F.covar_samp(a, b).alias(f"c_{a}_{b}")]
    row = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n_{a}_{b}").alias("n"), F.col(f"c_{a}_{b}").alias("cov")) for a, b in pairs])
    out = row.select(F.explode(cells).alias("c")).select("c.*")
    return out.withColumn("cov", F.when((F.col("a") != F.col("b")) & (F.col("n") < min_pairs), 0.0).otherwise(F.col("cov"))) if min_pairs else out


def missing_phi(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, phi): correlation of the missing indicators; 0 where one is constant."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    row = flags.agg(*[F.coalesce(F.nanvl(F.corr(a, b), F.lit(None)), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("phi")) for a, b in pairs])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def little_test(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row d2, df, p_value of Little's test that values are missing completely at random.

    Pattern means against the available-case mean, in the metric of the
    available-case covariance (plus 1e-8 on the diagonal), patterns of at least
    two rows.
    """
    p = collect(df, columns)
    width = len(columns)
    cov = {(r["a"], r["b"]): r["cov"] for r in pairwise_cov(df, columns).collect()}
    raw = np.array([[cov[(columns[min(i, j)], columns[max(i, j)])] or 0.0 for j in range(width)] for i in range(width)])
    d2, free = 0.0, 0
    for b in p.blocks.values():
        if b.n >= 2 and len(b.obs):
            gap = b.s / b.n * p.scale[b.obs]
            s = raw[np.ix_(b.obs, b.obs)] + 1e-8 * np.eye(len(b.obs))
            d2 += b.n * gap @ np.linalg.solve(s, gap)
            free += len(b.obs)
    free = max(1, free - width)
    return df.sparkSession.createDataFrame([(float(d2), free, chi2_sf(float(d2), free))], "d2 double, df int, p_value double")


def rank_sums(df: DataFrame, value: str, split: str) -> DataFrame:
    """One row for rows with ``value`` observed, split by whether ``split`` is missing: means, n, rank sum and U.

    Average ranks come from counts per distinct value: the running count is over
    distinct values, not rows.
    """
    x = ranked(df, value, F.count(F.when(F.col(split).isNull(), 1)).alias("c1"))
    out = x.agg(
        F.sum("c1").alias("n_missing"), F.sum(F.col("c") - F.col("c1")).alias("n_observed"), F.try_divide(F.sum(F.col("v") * F.col("c1")), F.sum("c1")).alias("mean_missing"),
        F.try_divide(F.sum(F.col("v") * (F.col("c") - F.col("c1"))), F.sum(F.col("c") - F.col("c1"))).alias("mean_observed"),
        F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("ties"),
    )
    return out.withColumn("u", F.col("r1") - F.col("n_missing") * (F.col("n_missing") + 1) / 2)


def descriptive_by_missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(missing_col, column, means, n, u, p_value) for every pair; p by the tie-corrected normal approximation.

    One ranking per column serves all indicators: its distinct values carry the
    number of their rows that lack each of the other columns.
    """
    rows = []
    for k in columns:
        others = [j for j in columns if j != k]
        x = ranked(df, k, *[F.count(F.when(F.col(j).isNull(), 1)).alias(f"c_{j}") for j in others])
        aggs = [F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"), F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("ties")]
        for j in others:
            aggs += [F.sum(f"c_{j}").alias(f"n_{j}"), F.sum(F.col("v") * F.col(f"c_{j}")).alias(f"s_{j}"), F.sum(F.col("rank") * F.col(f"c_{j}")).alias(f"r_{j}")]
        t = x.agg(*aggs).first()
        for j in others:
            n1 = t[f"n_{j}"] or 0
            n0 = (t["n"] or 0) - n1
            u = None if t[f"r_{j}"] is None else t[f"r_{j}"] - n1 * (n1 + 1) / 2
            p = None
            if n1 >= 2 and n0 >= 2:
                n = n1 + n0
                var = n1 * n0 / 12 * ((n + 1) - t["ties"] / (n * (n - 1)))
                p = 1.0 if var <= 0 else min(1.0, two_sided_p(max(0.0, abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(var)))
            rows.append((j, k, n1, n0, t[f"s_{j}"] / n1 if n1 else None, (t["s"] - t[f"s_{j}"]) / n0 if n0 else None, u, p))
    rows.sort(key=lambda r: (columns.index(r[0]), columns.index(r[1])))
    return df.sparkSession.createDataFrame(rows, "missing_col string, column string, n_missing long, n_observed long, mean_missing double, mean_observed double, u double, p_value double")


def null_loglik(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_missing, loglik): the intercept-only model of each missing indicator."""
    rows = long_form(df, columns).groupBy("feature").agg(F.count("*").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"))
    pi = F.col("n_missing") / F.col("n")
    inside = (pi > 0) & (pi < 1)
    return rows.withColumn("loglik", F.when(inside, F.col("n") * (pi * F.log(pi) + (1 - pi) * F.log(1 - pi))).otherwise(F.lit(0.0)))


def mar_plausibility(df: DataFrame, columns: list[str], steps: int = 12) -> DataFrame:
    """(feature, lr, df, p_value): does the missingness of a column depend on the other columns?

    Logistic regressions of each indicator on the mean-filled others by Newton
    steps; gradients and Hessians of all columns are summed in one job a step.
    """
    from lacuna.operators.logistic import newton_sums

    means = df.agg(*[F.avg(c).alias(c) for c in columns], *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns]).first()
    z = df.select(*[F.coalesce((F.col(c) - F.lit(float(means[c] or 0))) / F.lit(float(means[f"sd_{c}"] or 1) or 1.0), F.lit(0.0)).alias(c) for c in columns], *[F.col(c).isNull().cast("double").alias(f"r_{c}") for c in columns])
    z = z.cache()
    rows = []
    try:
        for c in columns:
            others = [o for o in columns if o != c]
            n, ones = z.agg(F.count("*"), F.sum(f"r_{c}")).first()
            if not ones or ones == n:
                continue
            beta = np.zeros(len(others) + 1)
            value = -math.inf
            for _ in range(steps):
                value, grad, hess = newton_sums(z, others, f"r_{c}", beta)
                move = np.linalg.solve(hess + 1e-6 * np.eye(len(beta)), grad)
                beta = beta + move
                if np.abs(move).max() < 1e-8:
                    break
            pi = ones / n
            null = n * (pi * math.log(pi) + (1 - pi) * math.log(1 - pi))
            lr = max(0.0, 2 * (value - null))
            rows.append((c, float(lr), len(others), chi2_sf(lr, len(others))))
    finally:
        z.unpersist()
    return df.sparkSession.createDataFrame(rows, "feature string, lr double, df int, p_value double")


def verdict(little_p: float, mar_p: list[float], alpha: float = 0.05) -> str:
    """OK_MCAR if Little's test passes, OK_MAR if the others explain at least half of the indicators, else WARN."""
    if little_p >= alpha:
        return "OK_MCAR"
    return "OK_MAR" if mar_p and sum(p < alpha for p in mar_p) / len(mar_p) >= 0.5 else "WARN"


def run_all(df: DataFrame, columns: list[str]) -> dict[str, DataFrame | str]:
    """Every diagnostic; the input is cached while they run, and only the tables of counts stay lazy."""
    df = df.select(*columns)
    held = df.cache()
    try:
        out: dict = {"little": little_test(held, columns), "mar": mar_plausibility(held, columns), "descriptive": descriptive_by_missingness(held, columns)}
    finally:
        held.unpersist()
    out |= {"patterns": pattern_summary(df, columns), "phi": missing_phi(df, columns)}
    out["verdict"] = verdict(out["little"].first()["p_value"], [r["p_value"] for r in out["mar"].collect()])
    return out


def canonical_order(df: DataFrame, columns: list[str]) -> list[Column]:
    """Ascending sort keys that put observed before missing, the first column first."""
    return [k for c in columns for k in (F.col(c).isNull(), F.col(c))]


def icc(df: DataFrame, y: str, group: str) -> DataFrame:
    """One row: groups, n and the one-way ANOVA intraclass correlation."""
    g = df.filter(F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    t = g.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("between"), F.sum("q").alias("q"))
    msb = (F.col("between") - F.col("s") * F.col("s") / F.col("n")) / (F.col("groups") - 1)
    msw = (F.col("q") - F.col("between")) / (F.col("n") - F.col("groups"))
    k = F.col("n") / F.col("groups")
    vb = F.greatest(F.lit(0.0), (msb - msw) / k)
    return t.select("groups", "n", F.when(vb + msw > 0, vb / (vb + msw)).otherwise(0.0).alias("icc"))


def task_rules(df: DataFrame, column: str) -> DataFrame:
    """One row: the task each of the three detection rules sees in an outcome."""
    t = df.filter(F.col(column).isNotNull()).agg(
        F.count_distinct(column).alias("n_distinct"), F.count(F.when(F.col(column) != F.floor(column), 1)).alias("n_fraction"), F.count(F.when(~F.col(column).isin(0, 1), 1)).alias("n_other")
    )
    named = lambda when: F.when(when, F.lit("classification")).otherwise(F.lit("regression"))
    whole = F.col("n_fraction") == 0
    return t.select(
        named(F.col("n_other") == 0).alias("zero_one"), named(whole & (F.col("n_distinct") <= 20)).alias("whole_numbers"),
        named((F.col("n_distinct") <= 2) | (whole & (F.col("n_distinct") <= 20))).alias("recommended"),
    )
