"""Many logistic fits in one pass: derivatives, closed comparisons, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.numerics import sigmoid
from lacuna.operators import logistic


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1.0]])
    y = (rng.random(1500) < sigmoid(0.4 + 1.2 * x[:, 0] - 0.7 * x[:, 2])).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    y[::17] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), None if np.isnan(t) else float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y double").repartition(5).cache()


def _packed(spark, df):
    mu, sigma = np.array([0.1, -0.2, 0.0]), np.array([[1.0, 0.4, 0.1], [0.4, 1.2, 0.3], [0.1, 0.3, 0.9]])
    masks = [format(i, "03b") for i in range(8)]
    return logistic.blocks(df, ["a", "b", "c"], "y", np.zeros(3), np.ones(3), F.col("k") % 3), lambda n: spark.sparkContext.broadcast([logistic.views(mu, sigma, masks)] * n)


def test_gradients_and_information_are_derivatives(spark, gappy):
    packed, seen = _packed(spark, gappy)
    theta = np.array([0.3, 0.9, -0.4, 0.2])
    e = np.eye(4) * 1e-4
    at = np.array([theta, *(theta + e), *(theta - e)])
    values, grads, hessians = logistic.score_many(packed, seen(len(at)), at)
    assert np.allclose((values[1:5] - values[5:]) / 2e-4, grads[0], rtol=1e-5, atol=1e-4)
    assert np.allclose((grads[1:5] - grads[5:]) / 2e-4, hessians[0], rtol=2e-3, atol=0.05)


def test_folds_are_left_out_or_taken_alone(spark, gappy):
    packed, seen = _packed(spark, gappy)
    thetas = np.tile([0.3, 0.9, -0.4, 0.2], (4, 1))
    out = logistic.score_many(packed, seen(4), thetas, np.array([0, 1, 2, -1]))[0]
    own = logistic.score_many(packed, seen(4), thetas, np.array([0, 1, 2, -1]), only=True)[0]
    assert np.allclose(out[:3] + own[:3], out[3]) and own[3] == 0 and np.isclose(own[:3].sum(), out[3])


def test_paths_equal_single_fits_and_share_their_jobs(spark, gappy, monkeypatch):
    x = ["a", "b", "c"]
    penalties = [(0.5, 0.0), (5.0, 0.0), (0.0, 8.0), (0.0, 40.0), (0.0, 1000.0)]
    made, own = [], logistic.score_many
    monkeypatch.setattr(logistic, "score_many", lambda *a, **b: made.append(1) or own(*a, **b))
    fold = F.pmod(F.col("k"), F.lit(4)).cast("int")
    found = logistic.fit_paths(gappy, x, "y", penalties, fold, 4)
    together, single = len(made), []
    assert len(found) == 20
    made.clear()
    for l2, l1 in penalties:
        logistic.fit(gappy, x, "y", l2, l1, compute_se=False)
        single.append(len(made))
    assert together <= 1 + max(np.diff([0, *single])) + 3
    path, model, held = found[6]  # fold 1, second penalty
    assert (path.fold, path.l2) == (1, 5.0) and held < 0
    alone = logistic.fit(gappy.filter(fold != 1), x, "y", 5.0, compute_se=False)
    assert np.allclose(model.coef, alone.coef, rtol=0.02, atol=0.01)  # but for the scale that the penalty refers to
    sparse = [m for p, m, _ in found if p.l1 == 1000.0]
    assert all((m.coef == 0).all() for m in sparse)


def test_lasso_meets_its_conditions_and_errors_tend_to_those_of_ridge(spark, gappy):
    x = ["a", "b", "c"]
    path, model, _ = logistic.fit_paths(gappy, x, "y", [(0.0, 40.0)], compute_se=True)[0]
    assert (model.coef == 0).any() and [s is None for s in model.se[1:]] == [c == 0 for c in model.coef]
    near, ridge = logistic.fit(gappy, x, "y", 0.0, 1e-6), logistic.fit(gappy, x, "y", 0.0)
    assert np.allclose(near.coef, ridge.coef, atol=1e-5) and np.allclose(near.se, ridge.se, rtol=1e-4)


def test_errors_equal_a_bootstrap(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 1))
    y = (rng.random(800) < sigmoid(0.3 + x[:, 0])).astype(float)

    def frame(at):
        return spark.createDataFrame([(float(x[i, 0]), float(y[i])) for i in at], "a double, y double")

    m = logistic.fit(frame(range(800)), ["a"], "y", 0.0)
    draws = [logistic.fit(frame(rng.integers(0, 800, 800)), ["a"], "y", 0.0, compute_se=False).coef[0] for _ in range(12)]
    assert 0.5 < np.std(draws, ddof=1) / m.se[1] < 1.7


def test_degenerate_tables(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (None, 1.0)], "a double, y double")
    m = logistic.fit(df, ["a"], "y")
    assert m.coef.tolist() == [0.0] and np.isclose(m.intercept, np.log(2), atol=1e-6)
    cv = logistic.cross_validate(df.withColumn("k", F.monotonically_increasing_id()), "k", ["a"], "y", [(1.0, 0.0)], 2)
    assert cv.count() == 2


def test_equal_rows_are_one_weighted_row(spark):
    """Repeated rows take a block's place once, and count as often as they come."""
    rows = [(i, float(i % 5) if i % 4 else None, i % 3 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, x double, b boolean").selectExpr("k", "x", "CAST(b AS INT) AS b").coalesce(1)
    packed = logistic.blocks(df, ["x"], "b", np.zeros(1), np.ones(1)).collect()
    assert sum(np.frombuffer(r.w).sum() for r in packed) == 3000
    assert sum(r.n for r in packed) == len({(x, b) for _, x, b in rows})
