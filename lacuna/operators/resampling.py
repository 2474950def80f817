"""Folds, bootstrap draws, scorers and cross-validation."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans.ranks import numbered, ranked


def kfold(df: DataFrame, key: str, k: int, seed: int | None = None) -> DataFrame:
    """Adds ``fold`` (0..k-1): contiguous in key order, or in hash order with a seed; sizes differ by one at most, larger first."""
    order = [F.col(key)] if seed is None else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    rows = numbered(df, order, "_pos")
    n = df.count()
    size, extra = divmod(n, k)
    head = extra * (size + 1)
    fold = F.when(F.col("_pos") <= head, F.floor((F.col("_pos") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("_pos") - 1 - head) / max(1, size)))
    return rows.withColumn("fold", fold.cast("int")).drop("_pos")


def stratified_kfold(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Adds ``fold``: rows of each label are dealt in key order; rows without a label are a stratum of their own."""
    rows = numbered(df, [F.col(label).isNull(), F.col(label), F.col(key)], "_pos")
    first = rows.groupBy(F.col(label).alias("_l")).agg(F.min("_pos").alias("_first"))
    out = rows.join(first, F.col(label).eqNullSafe(F.col("_l")))
    return out.withColumn("fold", ((F.col("_pos") - F.col("_first")) % k).cast("int")).drop("_pos", "_l", "_first")


def bootstrap(df: DataFrame, key: str, n: int, members: int, draw: Callable[[Column, Column], Column]) -> DataFrame:
    """(member, key, times): rows drawn with replacement; ``draw(member, i)`` gives the place (0..n-1) of draw i."""
    places = df.sparkSession.range(members).withColumnRenamed("id", "member").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = places.select("member", draw(F.col("member"), F.col("i")).alias("_at")).groupBy("member", "_at").agg(F.count("*").alias("times"))
    rows = numbered(df.select(key), [F.col(key)], "_pos")
    return drawn.join(rows, F.col("_at") == F.col("_pos") - 1).select("member", key, "times")


def out_of_bag(df: DataFrame, key: str, drawn: DataFrame, members: int) -> DataFrame:
    """(member, key) of the rows a member never drew."""
    every = df.select(key).withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long"))))
    return every.join(drawn.select("member", key), ["member", key], "left_anti").select("member", key)


def regression_scores(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """n, r2, rmse, mae, mse over rows with both values."""
    gap = F.col(y) - F.col(prediction)
    t = df.filter(F.col(y).isNotNull() & F.col(prediction).isNotNull()).agg(
        F.count("*").alias("n"), F.sum(gap * gap).alias("_e"), F.sum(F.abs(gap)).alias("_a"), (F.var_pop(y) * F.count("*")).alias("_v")
    )
    return t.select("n", F.when(F.col("_v") > 0, 1 - F.col("_e") / F.col("_v")).alias("r2"), F.sqrt(F.col("_e") / F.col("n")).alias("rmse"), (F.col("_a") / F.col("n")).alias("mae"), (F.col("_e") / F.col("n")).alias("mse"))


def classification_scores(df: DataFrame, y: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """n, accuracy, f1, brier, auc (average ranks over distinct probabilities) and f1_weighted (of both classes, by their numbers)."""
    rows = df.filter(F.col(y).isNotNull() & F.col(probability).isNotNull())
    hit = F.col(probability) >= threshold
    t = rows.agg(
        F.count("*").alias("n"), F.avg((hit.cast("int") == F.col(y)).cast("double")).alias("accuracy"), F.avg((F.col(probability) - F.col(y)) ** 2).alias("brier"),
        F.count(F.when(hit & (F.col(y) == 1), 1)).alias("_tp"), F.count(F.when(hit & (F.col(y) == 0), 1)).alias("_fp"), F.count(F.when(~hit & (F.col(y) == 1), 1)).alias("_fn"),
    )
    x = ranked(rows, probability, F.sum(F.col(y).cast("double")).alias("c1"))
    a = x.agg(F.sum(F.col("rank") * F.col("c1")).alias("r"), F.sum("c1").alias("n1"), F.sum(F.col("c") - F.col("c1")).alias("n0"))
    auc = F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0")))
    t = t.withColumn("f1", F.when(2 * F.col("_tp") + F.col("_fp") + F.col("_fn") > 0, 2 * F.col("_tp") / (2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))).otherwise(0.0))
    tn = F.col("n") - F.col("_tp") - F.col("_fp") - F.col("_fn")
    other = F.when(2 * tn + F.col("_fp") + F.col("_fn") > 0, 2 * tn / (2 * tn + F.col("_fp") + F.col("_fn"))).otherwise(0.0)
    t = t.withColumn("f1_weighted", F.try_divide(F.col("f1") * (F.col("_tp") + F.col("_fn")) + other * (tn + F.col("_fp")), F.col("n")))
    return t.crossJoin(a.select(auc.alias("auc"))).select("n", "accuracy", "f1", "brier", "auc", "f1_weighted")  # one row each


def class_scores(df: DataFrame, y: str, prediction: str) -> dict[str, float | None]:
    """n, accuracy and f1_weighted of predicted classes of any kind; rows without either do not count."""
    rows = df.filter(F.col(y).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(y).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(F.count("*").alias("n")).collect()  # classes by classes
    n = sum(r["n"] for r in rows)
    total = 0.0
    for c in {r["y"] for r in rows}:
        hit, own, said = (sum(r["n"] for r in rows if keep(r)) for keep in (lambda r: r["y"] == r["p"] == c, lambda r: r["y"] == c, lambda r: r["p"] == c))  # noqa: B023
        total += own * 2 * hit / (own + said)
    return {"n": n, "accuracy": sum(r["n"] for r in rows if r["y"] == r["p"]) / n if n else None, "f1_weighted": total / n if n else None}


#: Scores of numbers; the others are of classes.
NUMBERS = ("r2", "rmse", "mae", "mse")
SCORERS = {"r2": ("r2", 1), "neg_root_mean_squared_error": ("rmse", -1), "neg_mean_absolute_error": ("mae", -1), "neg_mean_squared_error": ("mse", -1), "accuracy": ("accuracy", 1), "f1": ("f1", 1), "f1_weighted": ("f1_weighted", 1), "roc_auc": ("auc", 1)}


def cross_validate(df: DataFrame, key: str, k: int, fit: Callable[[DataFrame], object], label: str, scoring: str | Callable[[object, DataFrame], float] = "r2", seed: int | None = 0) -> DataFrame:
    """(fold, score): fits on all folds but one, scores the one by name or by ``scoring(model, rows)``; a fold whose fit fails scores NULL."""
    if not callable(scoring) and scoring not in SCORERS:
        raise ValueError(f"scoring must be one of {', '.join(sorted(SCORERS))}, not {scoring!r}")
    name, sign = ("", 1) if callable(scoring) else SCORERS[scoring]
    rows = kfold(df, key, k, seed).cache()
    out = []
    try:
        for fold in range(k):
            try:
                model = fit(rows.filter(F.col("fold") != fold))
                if callable(scoring):
                    value = float(scoring(model, rows.filter(F.col("fold") == fold).drop("fold")))
                    out.append((fold, None if math.isnan(value) else value))
                    continue
                predicted = model.transform(rows.filter(F.col("fold") == fold))
                scores = regression_scores(predicted, label, "prediction") if name in NUMBERS else classification_scores(predicted, label, "probability")
                value = scores.first()[name]
                out.append((fold, None if value is None or math.isnan(value) else sign * value))
            except (ValueError, ArithmeticError):
                out.append((fold, None))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "fold int, score double")


def cross_validate_metrics(df: DataFrame, key: str, k: int, fit: Callable[[DataFrame], object], label: str, scoring: tuple[str, ...], seed: int | None = 0, group: str | None = None, train_scores: bool = False) -> DataFrame:
    """(fold, metric, seconds, test, train): several scores of each fold's one fit.

    With ``group`` whole groups are dealt, so that none is in training and test
    rows at once.  A fold whose fit fails scores NULL; every fit starts afresh.
    """
    unknown = [s for s in scoring if s not in SCORERS]
    if unknown or not scoring:
        raise ValueError(f"scoring must be among {', '.join(sorted(SCORERS))}, not {unknown or 'empty'}")
    if group:
        rows = df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed or 0), F.col(group)), F.lit(k)).cast("int")).cache()
    else:
        rows = kfold(df, key, k, seed).cache()
    out = []

    def values(model, part: DataFrame) -> dict[str, float | None]:
        predicted = model.transform(part)
        if "probabilities" in predicted.columns and "probability" not in predicted.columns:
            predicted = predicted.withColumn("probability", F.element_at("probabilities", -1))
        kinds = {n in NUMBERS for n, _ in (SCORERS[s] for s in scoring)}
        got: dict = {}
        if True in kinds:
            got |= regression_scores(predicted, label, "prediction").first().asDict()
        if False in kinds:
            got |= classification_scores(predicted, label, "probability").first().asDict()
        return {s: None if got[SCORERS[s][0]] is None or math.isnan(got[SCORERS[s][0]]) else SCORERS[s][1] * got[SCORERS[s][0]] for s in scoring}

    try:
        for fold in range(k):
            train, test = rows.filter(F.col("fold") != fold).drop("fold"), rows.filter(F.col("fold") == fold).drop("fold")
            began = time.perf_counter()
            try:
                model = fit(train)
                spent = time.perf_counter() - began
                tested = values(model, test)
                trained = values(model, train) if train_scores else {}
            except (ValueError, ArithmeticError):
                spent, tested, trained = None, {}, {}
            out += [(fold, s, spent, tested.get(s), trained.get(s)) for s in scoring]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "fold int, metric string, seconds double, test double, train double")


def aggregate_folds(scores: DataFrame) -> DataFrame:
    """n, mean and sd of the folds' scores, failed folds left out."""
    return scores.agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
