"""Benchmark arms: ways to deal with missing cells, compared fold by fold.

Every arm prepares a training and a test table; the arm ``model`` leaves them as
they are and fits a family that integrates over what is missing, the others fit
a penalised regression on completed tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.checks import check_choice, check_positive_int
from lacuna.operators import linear, logistic, neighbors, resampling, results, workflow
from lacuna.operators.auto import Estimator
from lacuna.plans.patterns import profile

ARMS = ("drop_rows", "drop_columns", "mean", "neighbors", "iterated", "model")
#: Strengths tried when a penalty is matched.
GRID = (0.01, 0.1, 1.0, 10.0)
METRICS = {"regression": ("r2", "rmse", "mae"), "classification": ("accuracy", "f1", "brier", "auc")}


def fill_with(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with the training means."""
    t = train.agg(*[F.avg(c).alias(c) for c in features]).first()
    put = {c: F.coalesce(F.col(c), F.lit(float(t[c] or 0.0))) for c in features}
    return train.withColumns(put), test.withColumns(put)


def fill_neighbors(train: DataFrame, rows: DataFrame, features: list[str], key: str, k: int = 5) -> DataFrame:
    """Missing cells become the mean of the k nearest training rows' observed cells, else the training mean."""
    place = neighbors.moments(train, features)
    means = train.agg(*[F.avg(c).alias(c) for c in features]).first()
    base = neighbors.expected(train, features, (key,), *place).withColumnRenamed(key, "_row")
    lacking = rows.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in features], F.lit(0)) == 1)
    found = neighbors.nearest(base, neighbors.expected(lacking, features, (key,), *place), "_row", key, len(features), k + 1)
    found = found.filter(F.col("query") != F.col("_row"))
    cells = train.select(F.col(key).alias("_r"), *[F.col(c).alias(f"_v_{c}") for c in features])
    # both sides grow with the table, so neither is sent through the driver
    means_of = found.join(cells.hint("merge"), F.col("_row") == F.col("_r")).groupBy(F.col("query").alias("_q")).agg(*[F.avg(f"_v_{c}").alias(f"_f_{c}") for c in features])
    out = rows.join(means_of.hint("merge"), F.col(key) == F.col("_q"), "left")
    put = {c: F.coalesce(F.col(c), F.col(f"_f_{c}"), F.lit(float(means[c] or 0.0))) for c in features}
    return out.withColumns(put).drop("_q", *[f"_f_{c}" for c in features])


def iterated(train: DataFrame, features: list[str], rounds: int = 10, ridge: float = 1e-3) -> Callable[[DataFrame], DataFrame]:
    """A filler by chained regressions: every column on the mean-filled, then refilled, others; one aggregation a round."""
    check_positive_int(rounds, "rounds", "iterated")
    prof = profile(train, features)
    center = {c: float(prof[c]["mean"] or 0.0) for c in features}
    scale = {c: float(prof[c]["sd"] or 1.0) or 1.0 for c in features}
    p = len(features)
    steps: list[np.ndarray] = []

    def filled(df: DataFrame) -> DataFrame:
        z = df.withColumns({f"_z_{c}": F.coalesce((F.col(c) - F.lit(center[c])) / F.lit(scale[c]), F.lit(0.0)) for c in features})
        for b in steps:
            now: dict[str, Column] = {}
            for j, c in enumerate(features):
                value = F.lit(float(b[j, p]))
                for i, other in enumerate(features):
                    if i != j:
                        value = value + F.lit(float(b[j, i])) * F.col(f"_z_{other}")
                now[f"_n_{c}"] = F.when(F.col(c).isNull(), value).otherwise(F.col(f"_z_{c}"))
            z = z.withColumns(now).withColumns({f"_z_{c}": F.col(f"_n_{c}") for c in features}).drop(*now)
        return z

    def done(df: DataFrame) -> DataFrame:
        return filled(df).withColumns({c: F.lit(center[c]) + F.lit(scale[c]) * F.col(f"_z_{c}") for c in features}).drop(*[f"_z_{c}" for c in features])

    if p < 2:
        return done
    for _ in range(rounds):
        z = filled(train)
        x = [*[F.col(f"_z_{c}") for c in features], F.lit(1.0)]
        seen = [F.col(c).isNotNull().cast("double") for c in features]
        t = z.agg(*[F.sum(seen[j] * x[i] * x[k]).alias(f"s{j}_{i}_{k}") for j in range(p) for i in range(p + 1) for k in range(i, p + 1)]).first()
        b = np.zeros((p, p + 1))
        for j in range(p):
            q = np.array([[t[f"s{j}_{min(i, k)}_{max(i, k)}"] or 0.0 for k in range(p + 1)] for i in range(p + 1)])
            on = [i for i in range(p + 1) if i != j]
            b[j, on] = np.linalg.solve(q[np.ix_(on, on)] + ridge * np.eye(p), q[on, j])
        steps.append(b)
    return done


def prepared(arm: str, train: DataFrame, test: DataFrame, features: list[str], key: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(training rows, test rows, features) as the arm sees them; dropped test rows get no prediction."""
    check_choice(arm, ARMS, "arm", "benchmark")
    if arm == "drop_rows":
        return workflow.drop_rows(train, features), workflow.drop_rows(test, features), features
    if arm == "drop_columns":
        kept = workflow.complete_columns(train, features)
        if not kept:
            raise ValueError("no column is complete in the training rows")
        return (*fill_with(train, test, kept), kept)
    if arm == "mean":
        return (*fill_with(train, test, features), features)
    if arm == "neighbors":
        return fill_neighbors(train, train, features, key), fill_neighbors(train, test, features, key), features
    if arm == "iterated":
        run = iterated(train, features)
        return run(train), run(test), features
    return train, test, features


def evaluate(arm: str, train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, task: str = "regression", family: str = "ridge", l2: float = 1.0) -> dict[str, float | None]:
    """The arm's scores on the test rows; None where it could not be fitted."""
    check_choice(task, tuple(METRICS), "task", "benchmark")
    try:
        tr, te, own = prepared(arm, train, test, features, key)
        if arm == "model":
            model = Estimator(family, task, **({"alpha": l2} if family == "ridge" else {})).fit(tr, own, label, key=key)
            out = model.transform(te)
            if task == "classification":
                out = out.withColumn("probability", F.col("probabilities")[1])
        elif task == "regression":
            out = linear.fit(tr, own, label, l2=l2, compute_se=False).transform(te)
        else:
            out = logistic.fit(tr, own, label, l2=l2, compute_se=False).transform(te)
        row = (resampling.regression_scores(out, label, "prediction") if task == "regression" else resampling.classification_scores(out, label, "probability")).first()
        return {m: row[m] for m in METRICS[task]}
    except (ValueError, ArithmeticError):
        return dict.fromkeys(METRICS[task])


def run_folds(df: DataFrame, features: list[str], label: str, key: str, task: str = "regression", folds: int = 5, seed: int | None = 0, arms: tuple[str, ...] = ARMS, family: str = "ridge", l2: float = 1.0) -> DataFrame:
    """(arm, fold, metric, score): every arm on every fold."""
    check_positive_int(folds, "folds", "benchmark", 2)
    rows = resampling.kfold(df.filter(F.col(label).isNotNull()), key, folds, seed).cache()
    out = []
    try:
        for fold in range(folds):
            train, test = rows.filter(F.col("fold") != fold).drop("fold"), rows.filter(F.col("fold") == fold).drop("fold")
            for arm in arms:
                out += [(arm, fold, m, None if v is None else float(v)) for m, v in evaluate(arm, train, test, features, label, key, task, family, l2).items()]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "arm string, fold int, metric string, score double")


def table(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., arm, metric, n, mean, sd, shown): the folds' scores, failed folds left out."""
    t = scores.groupBy(*by, "arm", "metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return t.withColumn("shown", F.concat(F.format_number("mean", 4), F.lit(" +- "), F.format_number(F.coalesce("sd", F.lit(0.0)), 4)))


def tests_against(scores: DataFrame, metric: str, arm: str = "model") -> DataFrame:
    """(baseline, n, mean_diff, sd_diff, t) of the arm against every other one, paired by fold."""
    own = scores.filter((F.col("metric") == metric) & (F.col("arm") == arm))
    parts = [results.paired_t(own, scores.filter((F.col("metric") == metric) & (F.col("arm") == b))).withColumn("baseline", F.lit(b)) for b in ARMS if b != arm]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.filter("n > 0").select("baseline", "n", "mean_diff", "sd_diff", "t")


def sweep(df: DataFrame, features: list[str], label: str, key: str, rates: tuple[float, ...], task: str = "regression", folds: int = 3, seed: int = 0, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """(rate, arm, fold, metric, score): cells are hidden at each rate before the folds; the draws are fixed by (seed, key, column)."""
    parts = []
    for rate in rates:
        hidden = df
        for c in features:
            draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
            hidden = workflow.inject_mcar(hidden, c, rate, draw)
        parts.append(run_folds(hidden, features, label, key, task, folds, seed, arms).withColumn("rate", F.lit(float(rate))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("rate", "arm", "fold", "metric", "score")


def degradation(scores: DataFrame, metric: str) -> DataFrame:
    """(rate, arm, mean, sd): what a plot of scores over missing rates needs."""
    return table(scores.filter(F.col("metric") == metric), ("rate",)).select("rate", "arm", "mean", "sd")


def matched_strength(df: DataFrame, features: list[str], label: str, key: str, task: str = "regression", grid: tuple[float, ...] = GRID, folds: int = 3, arm: str = "model") -> float:
    """The penalty of the grid with the best cross-validated score of an arm, ties to the smaller one."""
    metric = "r2" if task == "regression" else "accuracy"
    if arm == "model" and task == "regression":
        rows = linear.cv_ridge(df.filter(F.col(label).isNotNull()), key, features, label, list(grid), folds).collect()
        return max(rows, key=lambda r: (r["r2"], -r["alpha"]))["alpha"]
    means = []
    for l2 in grid:
        row = run_folds(df, features, label, key, task, folds, 0, (arm,), l2=l2).filter(F.col("metric") == metric).agg(F.avg("score").alias("m")).first()
        means.append((row["m"] if row["m"] is not None else -np.inf, -l2))
    return -max(means)[1]


#: Generated tables: rows, features, noise or share of ones.
REGRESSION_SETS = {"small": (300, 5, 0.3), "medium": (1500, 10, 1.0), "large": (6000, 20, 2.0)}
CLASSIFICATION_SETS = {"small": (400, 5, 0.5), "medium": (1500, 10, 0.3), "large": (5000, 15, 0.4)}


def generated(spark, rows: int, features: int, task: str = "regression", noise: float = 1.0, rate: float = 0.25, share: float = 0.6, seed: int = 42) -> DataFrame:
    """(k, x1.., y) of a linear truth, with cells of the first ``share`` of the columns hidden by the next column's median.

    For classification ``noise`` is the share of ones.  Every cell is a function of (seed, row, column).
    """

    def normal(column: int) -> Column:
        u, v = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(column), F.lit(i), F.col("k")), F.lit(1 << 40)) + 0.5) / float(1 << 40) for i in (0, 1))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)

    names = [f"x{j + 1}" for j in range(features)]
    weights = np.random.default_rng(seed).normal(0, 1, features)
    df = spark.range(rows).withColumnRenamed("id", "k").select("k", *[normal(j).alias(c) for j, c in enumerate(names)])
    signal = sum((F.lit(float(w)) * F.col(c) for c, w in zip(names, weights, strict=True)), F.lit(0.0))
    if task == "regression":
        df = df.withColumn("y", signal + F.lit(float(noise)) * normal(features))
    else:
        df = df.withColumn("_s", signal + normal(features))
        df = df.withColumn("y", (F.col("_s") > F.lit(float(df.agg(F.percentile("_s", 1 - noise)).first()[0]))).cast("int")).drop("_s")
    hidden = names[: max(1, round(share * features))]
    each = min(0.85, rate * features / len(hidden))
    full = df
    for j, c in enumerate(hidden):
        draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit("hide"), F.lit(j), F.col("k")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        by = names[(j + 1) % features]
        middle = full.agg(F.percentile(by, 0.5)).first()[0]
        above = F.col(by) > F.lit(float(middle))
        chance = F.when(F.coalesce(above, F.lit(False)), min(0.85, 4 / 3 * each)).otherwise(2 / 3 * each)
        df = workflow.inject(df, c, chance, draw)
    return df
