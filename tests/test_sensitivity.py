"""Sensitivity sweeps: every cell against a fit of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.numerics import sigmoid
from lacuna.operators import ensemble, sensitivity

SHIFTS = np.array([-1.5, 0.0, 2.0])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    n = 600
    g = np.minimum(rng.geometric(0.05, n), 40)
    x = rng.normal(size=(n, 2)) * [1.0, 3.0] + [2.0, -1.0]
    y = 1 + 0.8 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=41)[g] + rng.normal(size=n)
    b = (rng.random(n) < sigmoid(0.5 + 0.9 * (x[:, 0] - 2))).astype(float)
    gone = rng.random(n) < 0.25
    return g, x, y, b, gone


@pytest.fixture(scope="module")
def done(spark, rows):
    """Two completed copies."""
    g, x, y, b, gone = rows
    out = []
    for i in (1, 2):
        rng = np.random.default_rng(i)
        filled, t = np.where(gone, y + rng.normal(size=len(y)), y), rng.normal(size=len(y))
        out += [(i, k, int(g[k]), float(x[k, 0]), float(x[k, 1]) + i * 0.1 * (k % 3), float(filled[k]), None if gone[k] else float(b[k]), float(gone[k]), float(t[k]) if gone[k] else None) for k in range(len(y))]
    return spark.createDataFrame(out, "imputation int, k long, g long, a double, c double, y double, b double, gone double, t double").repartition(5).cache()


def _cells(done, shifts):
    p = done.toPandas()
    for i in (1, 2):
        own = p[p.imputation == i].sort_values("k")
        for s in shifts:
            yield own, s, np.column_stack([np.ones(len(own)), own.a, own.c])


def test_least_squares_cells(done):
    got = sensitivity.linear_cells(done, ["a", "c"], "y", "gone", SHIFTS)
    for k, (own, s, x) in enumerate(_cells(done, SHIFTS)):
        y = (own.y + s * own.gone).to_numpy()
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        cov = np.linalg.inv(x.T @ x) * ((y - x @ beta) ** 2).sum() / (len(y) - 3)
        assert np.allclose(got.coef[k // 3, k % 3], beta, atol=1e-9) and np.allclose(got.cov[k // 3, k % 3], cov, rtol=1e-7)
    at, se = got.pooled()
    assert np.allclose(at, got.coef.mean(0)) and np.allclose(se**2, np.diagonal(got.cov, axis1=2, axis2=3).mean(0) + 1.5 * got.coef.var(0, ddof=1))


def test_penalties_shrink_and_select(done):
    ridge = sensitivity.linear_cells(done, ["a", "c"], "y", "gone", SHIFTS, l2=500.0)
    free = sensitivity.linear_cells(done, ["a", "c"], "y", "gone", SHIFTS)
    assert (np.abs(ridge.coef[..., 1:]) < np.abs(free.coef[..., 1:])).all()
    lasso = sensitivity.linear_cells(done, ["a", "c"], "y", "gone", SHIFTS, l1=1e5)
    assert (lasso.coef[..., 1:] == 0).all() and np.isnan(lasso.cov[..., 1, 1]).all() and not np.isnan(lasso.cov[..., 0, 0]).any()


def test_logistic_cells(done):
    got = sensitivity.logistic_cells(done, ["a", "c"], "b", "t", SHIFTS, l2=0.0)
    for k, (own, s, x) in enumerate(_cells(done, SHIFTS)):
        y = np.where(own.b.isna(), own.t < s, own.b == 1).astype(float)
        beta = np.zeros(3)
        for _ in range(30):
            p = sigmoid(x @ beta)
            h = x.T @ (x * (p * (1 - p))[:, None])
            beta = beta + np.linalg.solve(h, x.T @ (y - p))
        assert np.allclose(got.coef[k // 3, k % 3], beta, atol=1e-6)
        assert np.allclose(got.cov[k // 3, k % 3], np.linalg.inv(h), rtol=1e-4)


def test_logistic_cells_with_a_lasso_and_a_constant_feature(done):
    got = sensitivity.logistic_cells(done.withColumn("one", F.lit(1.0)), ["a", "one", "c"], "b", "t", SHIFTS, l2=0.0, l1=1e4)
    assert (got.coef[..., 1:] == 0).all() and np.isnan(got.cov[..., 2, 2]).all()
    with pytest.raises(ValueError):
        sensitivity.logistic_cells(done, ["a"], "b", "t", SHIFTS[::-1])


def test_mixed_cells_reach_the_greatest_likelihood(done):
    cells = sensitivity.MixedCells(done, ["a", "c"], "y", "gone", "g", SHIFTS)
    got, tau2, sigma2 = cells.fit()
    cells.release()

    def loglik(own, y, x, t2, s2):
        v = s2 * np.eye(len(y)) + t2 * (own.g.to_numpy()[:, None] == own.g.to_numpy())
        inverse = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
        r = y - x @ beta
        return -0.5 * (np.linalg.slogdet(v)[1] + r @ inverse @ r), beta, np.linalg.inv(x.T @ inverse @ x)

    for k, (own, s, x) in enumerate(_cells(done, SHIFTS)):
        y, at = (own.y + s * own.gone).to_numpy(), (k // 3, k % 3)
        best, beta, cov = loglik(own, y, x, tau2[at], sigma2[at])
        assert np.allclose(got.coef[at], beta, atol=1e-7) and np.allclose(got.cov[at], cov, rtol=1e-6)
        for u, v in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98)):
            assert loglik(own, y, x, u * tau2[at], v * sigma2[at])[0] < best
        assert tau2[at] > 0.1


def test_mixed_cells_without_group_effects(done):
    """Groups that differ less than chance has it get no variance, and least squares remains."""
    flat = done.withColumn("g", F.pmod("k", F.lit(7))).withColumn("y", F.col("a") + (F.floor(F.col("k") / 7) % 2))
    cells = sensitivity.MixedCells(flat, ["a"], "y", "gone", "g", [0.0])
    got, tau2, _ = cells.fit()
    cells.release()
    assert (tau2 < 1e-6).all() and np.allclose(got.coef, sensitivity.linear_cells(flat, ["a"], "y", "gone", [0.0]).coef, atol=1e-6)


@pytest.fixture(scope="module")
def table(spark, rows):
    g, x, y, b, gone = rows
    out = [(k, int(g[k]), None if k % 9 == 0 else float(x[k, 0]), float(x[k, 1]), None if gone[k] else float(y[k]), None if gone[k] else float(b[k])) for k in range(len(y))]
    return spark.createDataFrame(out, "k long, g long, a double, c double, y double, b double").cache()


@pytest.mark.parametrize(("family", "label"), [("linear", "y"), ("ridge", "y"), ("lasso", "y"), ("mixed", "y"), ("logistic", "b"), ("ridge", "b"), ("lasso", "b")])
def test_sweep_of_every_family(table, family, label):
    curve = sensitivity.sweep(table, ["a", "c"], label, "k", family, "g" if family == "mixed" else None, imputations=3, deltas=5).cache()
    assert curve.count() == 10 and curve.filter("coef IS NULL OR isnan(coef)").isEmpty()
    at = {(r.feature, r.delta_std): r for r in curve.collect()}
    assert abs(at["a", 0.0].coef - (0.8 if label == "y" else 0.9)) < (0.25 if label == "y" else 0.35) and at["a", 0.0].se > 0
    assert at["a", 3.0].coef != at["a", -3.0].coef
    assert {r.verdict for r in ensemble.sensitivity_summary(curve).collect()} <= {"ROBUST", "MILD", "SENSITIVE"}


def test_sweep_does_not_depend_on_partitions(table):
    a, b = (sensitivity.sweep(t, ["a", "c"], "b", "k", "logistic", imputations=2, deltas=3).orderBy("feature", "delta_std").collect() for t in (table, table.repartition(7)))
    assert np.allclose([r.coef for r in a], [r.coef for r in b], atol=1e-7)


def test_a_complete_outcome_is_flat_and_others_are_refused(table):
    flat = sensitivity.sweep(table.filter("y IS NOT NULL"), ["c"], "y", "k", imputations=2, deltas=3)
    assert len({round(r.coef, 9) for r in flat.collect()}) == 1
    for bad in ({"family": "knn"}, {"family": "mixed"}, {"family": "logistic"}, {"imputations": 0}):
        with pytest.raises(ValueError):
            sensitivity.sweep(table, ["a"], "y", "k", **bad)
