"""Shapley values over the lattice of coalitions."""

import math
import time
from itertools import permutations

import numpy as np
import pytest

from lacuna.operators import explain, linear


def test_lattice_equals_all_orders():
    v = np.random.default_rng(0).normal(size=(3, 16))
    want = np.zeros((3, 4))
    for order in permutations(range(4)):
        mask = 0
        for j in order:
            want[:, j] += v[:, mask | 1 << j] - v[:, mask]
            mask |= 1 << j
    assert np.allclose(explain.lattice(v, 4), want / math.factorial(4))


def _model(width, rng):
    root = rng.normal(size=(width, width))
    return linear.LinearModel([f"x{j}" for j in range(width)], 1.0, rng.normal(size=width), 1.0, rng.normal(size=width), root @ root.T + np.eye(width))


def _rows(spark, n, width, rng):
    x = rng.normal(size=(n, width))
    gone = rng.random(x.shape) < 0.2
    return spark.createDataFrame([(i, *(None if g else float(v) for v, g in zip(r, h, strict=True))) for i, (r, h) in enumerate(zip(x, gone, strict=True))], "k long, " + ", ".join(f"x{j} double" for j in range(width))), gone


@pytest.mark.parametrize("width,rows,seconds", [(12, 2000, 60), (15, 3, 120)])
def test_many_features(spark, width, rows, seconds):
    rng = np.random.default_rng(1)
    model, (df, gone) = _model(width, rng), _rows(spark, rows, width, rng)
    began = time.perf_counter()
    got = np.zeros((rows, width))
    out = explain.exact(model, df, "k", model.features)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        got[r.k, int(r.feature[1:])] = r.phi
    assert time.perf_counter() - began < seconds and "Exchange" not in plan
    full = np.array([r.prediction for r in model.transform(df).orderBy("k").collect()])
    assert np.allclose(got.sum(1) + explain.baseline(model, df, model.features), full) and not got[gone].any()


def test_refusal(spark):
    rng = np.random.default_rng(2)
    with pytest.raises(ValueError, match="at most 15"):
        explain.exact(_model(16, rng), _rows(spark, 1, 16, rng)[0], "k", [f"x{j}" for j in range(16)])
