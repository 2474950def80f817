"""Bagging, one-vs-rest and sensitivity sweeps over any estimator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.checks import check_positive_int
from lacuna.operators import resampling, results, sensitivity
from lacuna.operators.auto import FAMILIES, Estimator, Fitted, classes_of, task_of
from lacuna.operators.linear import multiple_imputation, poisson_draws


def draws(member: int, key: str, seed: int = 0, cluster: str | None = None) -> Column:
    """How often a member draws a row: Poisson(1), the same for all rows of a cluster if one is named.

    A fixed function of (seed, member, key): no shuffle, no driver list, the
    same after a lost executor.
    """
    return poisson_draws(member, cluster or key, seed)


def bag_weights(df: DataFrame, key: str, member: int, seed: int = 0, cluster: str | None = None, keep_copy: bool = False) -> DataFrame:
    """``df`` with rows repeated as often as the member draws them; ``_copy`` numbers the repeats if kept.

    A repeated cluster is one more cluster: its copies get names of their own.
    """
    out = df.withColumn("_times", draws(member, key, seed, cluster)).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")
    if cluster:
        out = out.withColumn(cluster, F.concat(F.col(cluster).cast("string"), F.when(F.col("_copy") > 1, F.concat(F.lit("__b"), F.col("_copy").cast("string"))).otherwise("")))
    return out if keep_copy else out.drop("_copy")


def bagged(df: DataFrame, key: str, fit: Callable[[DataFrame], object], members: int = 10, seed: int = 0, cluster: str | None = None) -> list:
    return [fit(bag_weights(df, key, m, seed, cluster)) for m in range(members)]


def predict_members(models: list, df: DataFrame, key: str, weights: list[float] | None = None) -> DataFrame:
    """(key, prediction, lo, hi) of an ensemble."""
    weights = weights or [1.0] * len(models)
    if any(w < 0 for w in weights) or not sum(weights):
        raise ValueError("weights must be non-negative and not all zero")
    parts = [m.transform(df).select(key, "prediction").withColumn("weight", F.lit(w / sum(weights))) for m, w in zip(models, weights, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return results.combine_members(out, key)


def one_vs_rest(df: DataFrame, key: str, label: str, classes: list, fit: Callable[[DataFrame, str], object]) -> DataFrame:
    """(key, class, probability, chosen): one binary fit per class; a failed fit answers an equal share."""
    parts = []
    for c in classes:
        binary = df.withColumn("_is", F.when(F.col(label).isNotNull(), (F.col(label) == c).cast("int")))
        try:
            scored = fit(binary, "_is").transform(binary).select(key, F.col("probability").alias("score"))
        except (ValueError, ArithmeticError):
            scored = binary.select(key, F.lit(1 / len(classes)).alias("score"))
        parts.append(scored.select(key, F.lit(c).alias("class"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return results.one_vs_rest(out, key)


def delta_sweep(df: DataFrame, features: list[str], label: str, key: str, imputations: int = 5, deltas: int = 25, reach: float = 3.0, seed: int = 0) -> DataFrame:
    """(feature, delta_std, coef, se): least squares with imputed outcomes shifted by delta standard deviations (``sensitivity.sweep`` takes any family)."""
    return sensitivity.sweep(df, features, label, key, "linear", None, imputations, deltas, reach, seed)


def feature_subset(features: list[str], share: float, member: int, seed: int = 0) -> list[str]:
    """A share of the features, chosen by hash for each member, in their own order."""
    if not 0 < share <= 1:
        raise ValueError("max_features must lie in (0, 1]")
    take = max(1, round(share * len(features)))
    rank = sorted(features, key=lambda c: hashlib.md5(f"{seed}/{member}/{c}".encode()).hexdigest())
    chosen = set(rank[:take])
    return [c for c in features if c in chosen]


def normal_weights(weights: list[float] | None, n: int) -> list[float]:
    """Weights that sum to 1; none given are equal."""
    weights = [1.0] * n if weights is None else list(weights)
    if len(weights) != n:
        raise ValueError(f"{len(weights)} weights for {n} members")
    if any(w < 0 or not np.isfinite(w) for w in weights) or not sum(weights):
        raise ValueError("weights must be non-negative and not all zero")
    return [w / sum(weights) for w in weights]


def aligned(probabilities: Column, own: list, classes: list) -> Column:
    """A member's probabilities in the ensemble's class order, 0 for a class it never saw."""
    unknown = [c for c in own if c not in classes]
    if unknown:
        raise ValueError(f"classes {unknown} are not the ensemble's")
    return F.array(*[probabilities[own.index(c)] if c in own else F.lit(0.0) for c in classes])


@dataclass
class Bagging:
    """Members of one or several families on bootstrap rows and feature subsets."""

    estimators: list[Estimator]
    members: int = 10
    max_features: float = 1.0
    weights: list[float] | None = None
    bootstrap: bool = True
    cluster: str | None = None
    oob: bool = False
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], label: str, key: str, group: str | None = None) -> Bagged:
        """Members take the estimators in turn; all must see the same task."""
        check_positive_int(self.members, "members", "ensemble")
        if not self.estimators or not all(isinstance(e, Estimator) for e in self.estimators):
            raise TypeError("ensemble: members must be estimators of this library, which take missing cells")
        task = task_of(df, label, "whole_numbers") if self.estimators[0].task == "auto" else self.estimators[0].task
        for e in self.estimators:
            if e.task not in ("auto", task) or not (FAMILIES[e.family].regressor if task == "regression" else FAMILIES[e.family].binary or FAMILIES[e.family].classifier):
                raise ValueError(f"ensemble: {e.family} cannot take part in a {task}")
        weights = normal_weights(self.weights, self.members)
        classes = classes_of(df, label) if task == "classification" else None
        fitted, subsets = [], []
        for m in range(self.members):
            e = self.estimators[m % len(self.estimators)]
            own = feature_subset(features, self.max_features, m, self.seed)
            rows = df
            if self.bootstrap:
                rows = bag_weights(df, key, m, self.seed, self.cluster, keep_copy=True)
                rows = rows.withColumn(key, F.concat_ws("/", F.col(key).cast("string"), F.col("_copy").cast("string"))).drop("_copy")
            fitted.append(Estimator(e.family, task, **e.parameters).fit(rows, own, label, key=key, group=group))
            subsets.append(own)
        model = Bagged(fitted, subsets, weights, task, classes, features, label, key)
        if self.oob and self.bootstrap:
            parts = [model.member(m, df.filter(draws(m, key, self.seed, self.cluster) == 0)) for m in range(self.members)]
            model.oob = model.combined(_union(parts)).join(df.select(F.col(key).alias("_k"), label), F.col(key) == F.col("_k")).drop("_k")
        return model


@dataclass
class Bagged:
    """Fitted members with their features and weights."""

    models: list[Fitted]
    subsets: list[list[str]]
    weights: list[float]
    task: str
    classes: list | None
    features: list[str]
    label: str
    key: str
    oob: DataFrame | None = None

    def member(self, m: int, df: DataFrame) -> DataFrame:
        """(key, weight, value or probabilities) of one member."""
        out = self.models[m].transform(df)
        value = F.col("prediction").cast("double") if self.task == "regression" else aligned(F.col("probabilities"), self.models[m].classes, self.classes)
        return out.select(self.key, F.lit(float(self.weights[m])).alias("weight"), value.alias("value"))

    def combined(self, rows: DataFrame) -> DataFrame:
        if self.task == "regression":
            return results.combine_members(rows.withColumnRenamed("value", "prediction"), self.key)
        total = F.sum("weight")
        shares = F.array(*[F.sum(F.col("weight") * F.col("value")[i]) / total for i in range(len(self.classes))])
        out = rows.groupBy(self.key).agg(shares.alias("probabilities"))
        at = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), at))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction with lo and hi, or probabilities and prediction."""
        found = self.combined(_union([self.member(m, df) for m in range(len(self.models))])).withColumnRenamed(self.key, "_member_key")
        own = [c for c in df.columns if c not in ("prediction", "lo", "hi", "probabilities")]
        return df.select(*own).join(found, F.col(self.key) == F.col("_member_key")).drop("_member_key")

    def oob_scores(self) -> DataFrame:
        """Scores on rows by the members that never drew them."""
        if self.oob is None:
            raise ValueError("fit with oob=True and bootstrap=True first")
        if self.task == "regression":
            return resampling.regression_scores(self.oob, self.label, "prediction")
        return self.oob.filter(F.col(self.label).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col(self.label)).cast("double")).alias("accuracy"))

    def importances(self) -> list[tuple[str, float, float]]:
        """(feature, weighted mean, weighted sd) over the members; a feature that a member lacks counts 0."""
        table = np.zeros((len(self.models), len(self.features)))
        for i, m in enumerate(self.models):
            for c, v, _ in m.importances():
                table[i, self.features.index(c)] = v
        w = np.array(self.weights)[:, None]
        mean = (w * table).sum(0)
        return [(c, float(a), float(b)) for c, a, b in zip(self.features, mean, np.sqrt((w * (table - mean) ** 2).sum(0)), strict=True)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def sensitivity_table(curve: DataFrame) -> DataFrame:
    """(delta_std, coef_<feature>.., se_<feature>..) of a sweep's long form."""
    return curve.groupBy("delta_std").pivot("feature").agg(F.first("coef").alias("coef"), F.first("se").alias("se"))


def sensitivity_summary(curve: DataFrame, threshold: float = 0.0, z: float = 1.959963984540054) -> DataFrame:
    """(feature, coef, se, least, greatest, sign_tip, interval_tip, verdict) of a sweep.

    sign_tip: the smallest shift at which the coefficient changes sides of the
    threshold; interval_tip: at which its interval starts or ceases to hold it.
    """
    at0 = curve.filter("delta_std = 0").select(F.col("feature").alias("_f"), F.col("coef").alias("_c"), F.col("se").alias("_s"))
    rows = curve.join(at0, F.col("feature") == F.col("_f"))
    side = lambda c: F.signum(F.col(c) - threshold)
    holds = lambda c, s: F.abs(F.col(c) - threshold) <= z * F.col(s)
    t = rows.groupBy("feature").agg(
        F.first("_c").alias("coef"), F.first("_s").alias("se"), F.min("coef").alias("least"), F.max("coef").alias("greatest"),
        F.min(F.when(side("coef") != side("_c"), F.abs("delta_std"))).alias("sign_tip"), F.min(F.when(holds("coef", "se") != holds("_c", "_s"), F.abs("delta_std"))).alias("interval_tip"),
    )
    verdict = F.when(F.col("sign_tip").isNull() | (F.col("sign_tip") >= 1), "ROBUST").when(F.col("sign_tip") >= 0.5, "MILD").otherwise("SENSITIVE")
    return t.withColumn("verdict", verdict)


def impute_fit_pool(df: DataFrame, features: list[str], label: str, key: str, fit: Callable[[DataFrame], list[tuple[str, float, float]]], imputations: int = 5, seed: int = 0, posterior: bool = False) -> DataFrame:
    """Fits on every completed copy and pools (name, estimate, standard error) by Rubin's rules; ``posterior`` see ``multiple_imputation``."""
    check_positive_int(imputations, "imputations", "imputer", 2)
    done = multiple_imputation(df, features, key, imputations, seed, posterior, label).persist()
    rows = []
    try:
        for i in range(1, imputations + 1):
            rows += [(i, name, float(value), None if se is None else float(se) ** 2) for name, value, se in fit(done.filter(F.col("imputation") == i))]
    finally:
        done.unpersist()
    return results.rubin(df.sparkSession.createDataFrame(rows, "imputation int, feature string, coef double, var double"))
