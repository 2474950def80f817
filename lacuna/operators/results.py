"""Result tables: coefficients, importances, pooling, combination of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.exprs import sqrt_or_null
from lacuna.functions.numerics import normal_quantile, t_two_sided, two_sided_p


def normalised(rows: DataFrame, value: str, out: str = "importance") -> DataFrame:
    """|value| as a share of the whole table (a small one: one row per feature)."""
    total = F.sum(F.abs(value)).over(W.partitionBy(F.lit(0)))
    return rows.withColumn(out, F.when(total > 0, F.abs(value) / total).otherwise(F.lit(0.0)))


def coefficient_table(coefs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(feature, coef, se) -> with z, confidence limits and importance; NULL where the se is."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    z = normal_quantile(1 - alpha / 2)
    out = coefs.withColumns({"z": F.when(F.col("se") > 0, F.col("coef") / F.col("se")), "lo": F.col("coef") - z * F.col("se"), "hi": F.col("coef") + z * F.col("se")})
    return normalised(out, "coef")


def wald_p(z: float | None) -> float | None:
    return None if z is None else two_sided_p(z)


def rubin(estimates: DataFrame, by: str = "feature", value: str = "coef", variance: str = "var") -> DataFrame:
    """Pools (imputation, by, value, variance): estimate, within, between, total, se, df.

    A missing, infinite or negative value or variance in any imputation makes
    all but m NULL: pooling fewer imputations than m would understate the error.
    Without variation between imputations df is infinite.
    """
    fine = F.col(value).isNotNull() & ~F.isnan(value) & F.col(variance).isNotNull() & (F.col(variance) >= 0) & (F.col(variance) < float("inf"))
    t = estimates.groupBy(by).agg(
        F.count("*").alias("m"), F.count(F.when(fine, 1)).alias("_fine"),
        F.avg(value).alias("estimate"), F.avg(variance).alias("within"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("between"),
    )
    whole = F.col("_fine") == F.col("m")
    t = t.withColumns({c: F.when(whole, F.col(c)) for c in ("estimate", "within", "between")})
    extra = (1 + 1 / F.col("m")) * F.col("between")
    r = F.try_divide(extra, F.col("within"))
    t = t.withColumn("total", F.col("within") + extra).withColumn("se", sqrt_or_null(F.col("within") + extra))
    free = F.when(F.col("within") == 0, F.when(extra > 0, (F.col("m") - 1).cast("double")).otherwise(F.lit(float("inf"))))
    free = free.when(r > 0, (F.col("m") - 1) * (1 + 1 / r) * (1 + 1 / r)).when(r == 0, F.lit(float("inf")))
    return t.withColumn("df", free).drop("_fine")


def rubin_p(estimate: float, se: float, df: float) -> float:
    return t_two_sided(estimate / se, df)


def combine_members(rows: DataFrame, key: str, value: str = "prediction", weight: str = "weight", lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """(key, prediction, lo, hi): weighted mean over an ensemble's members and their quantiles."""
    w = F.col(weight)
    return rows.groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("prediction"), F.percentile(value, lo).alias("lo"), F.percentile(value, hi).alias("hi"))


def one_vs_rest(scores: DataFrame, key: str) -> DataFrame:
    """(key, class, score) -> probabilities over the classes that sum to 1 and the largest's flag; all zero gives equal shares."""
    of = W.partitionBy(key)
    total = F.sum("score").over(of)
    p = F.when(total > 0, F.col("score") / total).otherwise(1 / F.count("*").over(of))
    out = scores.withColumn("probability", p)
    return out.withColumn("chosen", F.row_number().over(of.orderBy(F.desc("probability"), "class")) == 1)


def paired_t(a: DataFrame, b: DataFrame, key: str = "fold", value: str = "score") -> DataFrame:
    """n, mean_diff, sd_diff and t of paired scores."""
    d = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key).select((F.col("_a") - F.col("_b")).alias("d"))
    t = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"))
    return t.withColumn("t", F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n"))))
