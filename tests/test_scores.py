"""Scores of fitted models: by name, by a function, and evaluated on other rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import linear, resampling
from lacuna.operators.auto import Estimator


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=120)
    return spark.createDataFrame([(i, float(v), float(2 * v + e), "abc"[int(np.digitize(v, [-0.4, 0.4]))], int(v > 0)) for i, (v, e) in enumerate(zip(x, rng.normal(size=120) * 0.3, strict=True))], "k long, x double, y double, c string, b int").cache()


def test_evaluate(rows):
    m = Estimator("ridge").fit(rows, ["x"], "y")
    got = m.evaluate(rows.filter("k < 50"))
    p = [(r.y, r.prediction) for r in m.transform(rows.filter("k < 50")).collect()]
    mse = np.mean([(a - b) ** 2 for a, b in p])
    assert got["n"] == 50 and np.isclose(got["mse"], mse) and np.isclose(got["rmse"], mse**0.5) and got["r2"] > 0.9
    two = Estimator("bayes", "classification").fit(rows, ["x"], "b").evaluate(rows)
    assert two["accuracy"] > 0.9 and 0.9 < two["auc"] <= 1 and set(two) == {"n", "accuracy", "f1_weighted", "f1", "brier", "auc"}


def test_weighted_f1_of_any_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "a"), (None, "a"), ("b", None)], "y string, p string")
    want = (3 * 2 * 2 / 5 + 1 * 2 * 1 / 4) / 5
    got = resampling.class_scores(df, "y", "p")
    assert got["n"] == 5 and np.isclose(got["f1_weighted"], want) and got["accuracy"] == 0.6
    assert resampling.class_scores(df.limit(0), "y", "p") == {"n": 0, "accuracy": None, "f1_weighted": None}


def test_scorers_by_name_and_by_function(rows):
    fit = lambda d: linear.fit(d, ["x"], "y", compute_se=False)
    by_name = {r.fold: r.score for r in resampling.cross_validate(rows, "k", 3, fit, "y", "neg_mean_squared_error").collect()}
    own = lambda m, d: -m.transform(d).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    by_function = {r.fold: r.score for r in resampling.cross_validate(rows, "k", 3, fit, "y", own).collect()}
    assert len(by_name) == 3 and all(v < 0 and np.isclose(v, by_function[k]) for k, v in by_name.items())
    with pytest.raises(ValueError, match="scoring"):
        resampling.cross_validate(rows, "k", 3, fit, "y", "mse")
