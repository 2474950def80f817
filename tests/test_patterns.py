"""Pattern sums: exact whatever the partitioning, wide tables by matrix products, EM over the tree of patterns."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.plans import gaussian, patterns


def _table(spark, x, parts=3):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"c{j} double" for j in range(x.shape[1]))).repartition(parts)


def _gappy(rows, width, rate=0.3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width)) @ rng.normal(size=(width, width)) + rng.normal(size=width) * 10
    x[rng.random(x.shape) < rate] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), 1.5, x[:, 0])
    return x


@pytest.mark.parametrize("width", [3, 12])
def test_sums_equal_numpy(spark, width):
    x = _gappy(400, width)
    x[:, 1] = x[:, 1] * 1e-6 + 5e3  # a spread far below the mean
    names = [f"c{j}" for j in range(width)]
    p = patterns.collect(_table(spark, x), names)
    assert np.allclose(p.center, np.nanmean(x, 0), rtol=1e-13) and np.allclose(p.scale, np.nanstd(x, 0, ddof=1), rtol=1e-9)
    gone = np.isnan(x)
    z = (x - p.center) / p.scale
    assert sum(b.n for b in p.blocks.values()) == 400
    for key, b in p.blocks.items():
        own = z[(gone == [c == "1" for c in key]).all(1)][:, b.obs]
        assert b.n == len(own) and np.allclose(b.s, own.sum(0), atol=1e-6) and np.allclose(b.q, own.T @ own, atol=1e-6)


@pytest.mark.parametrize("width", [4, 11])
def test_partitioning_does_not_change_a_bit(spark, width):
    x = _gappy(1500, width, seed=3) * np.geomspace(1e-8, 1e8, width)
    names = [f"c{j}" for j in range(width)]
    found = [patterns.collect(_table(spark, x, parts), names) for parts in (1, 7, 211)]
    for p in found[1:]:
        assert (p.center == found[0].center).all() and (p.scale == found[0].scale).all() and list(p.blocks) == list(found[0].blocks)
        assert all((b.s == a.s).all() and (b.q == a.q).all() for a, b in zip(found[0].blocks.values(), p.blocks.values(), strict=True))
    a, b = (gaussian.em(p) for p in found[:2])
    assert (a.mu == b.mu).all() and (a.sigma == b.sigma).all()


def test_groups_of_wide_tables(spark):
    x = _gappy(300, 10)
    names = [f"c{j}" for j in range(10)]
    df = _table(spark, x).withColumn("g", F.when(F.col("k") % 3 == 0, "a").when(F.col("k") % 3 == 1, "b"))
    by = patterns.collect(df, names, by=("g",))
    assert set(by) == {("a",), ("b",), (None,)} and sum(p.n for p in by.values()) == 300
    total = patterns.collect(df, names)
    for key, b in total.blocks.items():
        parts = [p.blocks[key] for p in by.values() if key in p.blocks]
        assert sum(q.n for q in parts) == b.n and np.allclose(sum(q.q for q in parts), b.q, atol=1e-9)


def test_refusals(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, float("inf")), (2.0, 1.0)], "a double, b double")
    with pytest.raises(ValueError, match="infinite"):
        patterns.collect(df, ["a", "b"])
    monkeypatch.setattr(patterns, "MAX_PATTERNS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        patterns.collect(_table(spark, _gappy(200, 9)), [f"c{j}" for j in range(9)])


def _plain_em(p, max_iter, tol, reg):
    """One pattern after another, as the definition has it."""
    mu, sigma = gaussian._start(*gaussian.pairwise(list(p.blocks.values()), len(p.columns)))
    old = -math.inf
    for _ in range(max_iter):
        rows, total, cross = 0.0, 0, 0
        for b, (n, t, c, cov) in zip(p.blocks.values(), gaussian.filled(p, mu, sigma), strict=True):
            if len(b.obs):
                rows, total, cross = rows + n, total + t, cross + c + n * cov
        mu = total / rows
        sigma = cross / rows - np.outer(mu, mu) + reg * np.eye(len(mu))
        new = gaussian.loglik(p, mu, sigma)
        if abs(new - old) < tol * (1 + abs(new)):
            break
        old = new
    return mu, sigma, new


def _many(count, width, seed=1):
    """Blocks of many random patterns, as if collected."""
    rng = np.random.default_rng(seed)
    root = rng.normal(size=(width, width))
    blocks = {}
    while len(blocks) < count:
        gone = rng.random(width) < 0.4
        z = (rng.normal(size=(3, width)) @ root)[:, ~gone]
        if not gone.all():
            blocks["".join("01"[int(g)] for g in gone)] = patterns.Block(np.flatnonzero(~gone), 3.0, z.sum(0), z.T @ z)
    return patterns.Patterns([f"c{j}" for j in range(width)], np.zeros(width), np.ones(width), blocks)


def test_tree_of_patterns_equals_plain_em_and_is_faster():
    p = _many(5000, 16)
    began = time.perf_counter()
    got = gaussian.em(p, 4, 0.0, 1e-6)
    fast, began = time.perf_counter() - began, time.perf_counter()
    mu, sigma, loglik = _plain_em(p, 4, 0.0, 1e-6)
    slow = time.perf_counter() - began
    assert np.abs(got.mu - mu).max() < 1e-10 and np.abs(got.sigma - sigma).max() < 1e-10 and abs(got.loglik - loglik) < 1e-9 * abs(loglik)
    assert slow > 5 * fast, (slow, fast)


def test_tree_with_columns_that_determine_each_other():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(200, 2))
    x = np.column_stack([z, z.sum(1)])
    p = patterns.Patterns(["a", "b", "c"], np.zeros(3), np.ones(3), {"000": patterns.Block(np.arange(3), 200.0, x.sum(0), x.T @ x), "110": patterns.Block(np.array([2]), 50.0, x[:50, 2:].sum(0), x[:50, 2:].T @ x[:50, 2:])})
    m = gaussian.em(p, 50)
    assert np.isfinite(m.mu).all() and np.isfinite(m.sigma).all()


def test_moments_on_the_cluster_equal_the_drivers(spark):
    df = _table(spark, _gappy(2500, 11), 5)
    names = [f"c{j}" for j in range(11)]
    near, a = gaussian.moments(df, names, 12, 1e-12, 1e-6)
    far, b = gaussian.moments(df, names, 12, 1e-12, 1e-6, most=50)
    assert isinstance(near, patterns.Patterns) and isinstance(far, gaussian.Spread) and len(near.blocks) > 400
    for u, v in zip(gaussian.raw_moments(near, a), gaussian.raw_moments(far, b), strict=True):
        assert np.allclose(u, v, rtol=1e-8, atol=1e-8)


def test_wide_fit_equals_least_squares(spark):
    from lacuna.operators import linear

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 60)) + rng.normal(size=(400, 1))
    y = x @ rng.normal(size=60) + rng.normal(size=400)
    names = [f"c{j}" for j in range(61)]
    df = _table(spark, np.column_stack([x, y]))
    m = linear.fit(df, names[:-1], names[-1], compute_se=False)
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert np.allclose([m.intercept, *m.coef], want, atol=1e-3)
    plan = patterns.wide_sums(df, names, (), np.zeros(61), np.ones(61), patterns.Digits.wide(400))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("MapInArrow") == 1


def test_the_profile_of_many_columns_is_that_of_few(spark, monkeypatch):
    x = _gappy(300, 12)
    x[:, 3] = np.nan
    x[:, 4] = x[:, 4] * 1e-6 + 5e3
    df, names = _table(spark, x, 7), [f"c{j}" for j in range(12)]
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    wide = patterns.profile(df, names)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    monkeypatch.setattr(patterns, "NARROW", 12)
    for c, want in patterns.profile(df, names).items():
        assert [wide[c][k] for k in ("rows", "n", "min", "max")] == [want[k] for k in ("rows", "n", "min", "max")]
        for k in ("mean", "sd"):
            assert wide[c][k] == want[k] or abs(wide[c][k] - want[k]) <= 1e-6 * abs(want[k])
    assert patterns.profile(df.limit(0), names)["c0"] == {"rows": 0, "n": 0, "mean": None, "sd": None, "min": None, "max": None}


def test_many_expressions_run_compiled(spark, monkeypatch):
    """While sums of a wide table are collected no method is longer than the JVM compiles."""
    seen = []
    collected = patterns._collected
    monkeypatch.setattr(patterns, "_collected", lambda *a: seen.append(int(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))) or collected(*a))
    patterns.collect(_table(spark, _gappy(40, 12)), [f"c{j}" for j in range(12)])
    assert seen == [8000]
