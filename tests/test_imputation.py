"""Multiple imputation: repeatable draws, moments of their own for each copy, the outcome as a variable."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import ensemble, linear
from lacuna.plans import patterns


def _half(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    b = rng.normal(size=n)
    a = 1 + 0.8 * b + rng.normal(size=n) * 0.6
    gone = rng.random(n) < 0.5
    return spark.createDataFrame([(i, None if g else float(u), float(v), "x") for i, (u, v, g) in enumerate(zip(a, b, gone, strict=True))], "k long, a double, b double, Imputation string"), a, b, gone


def _between(done):
    means = [r.m for r in done.groupBy("imputation").agg(F.avg("a").alias("m")).collect()]
    return np.var(means, ddof=1)


def test_posterior_copies_vary_as_a_full_bootstrap_does(spark):
    df, a, b, gone = _half(spark)
    rng = np.random.default_rng(7)
    means = []
    for _ in range(400):
        at = rng.integers(0, len(a), len(a))
        x, y = b[at][~gone[at]], a[at][~gone[at]]
        slope = np.cov(x, y, bias=True)[0, 1] / x.var()
        rest = np.std(y - slope * x)
        draw = y.mean() + slope * (b - x.mean()) + rng.normal(size=len(a)) * rest
        means.append(np.where(gone, draw, a).mean())
    proper = _between(linear.multiple_imputation(df, ["a", "b"], "k", 60, posterior=True))
    plain = _between(linear.multiple_imputation(df, ["a", "b"], "k", 60))
    assert 0.55 < proper / np.var(means) < 1.8 and proper > 1.4 * plain


def test_draws_do_not_depend_on_partitions(spark):
    df, *_ = _half(spark)
    one, other = (linear.multiple_imputation(d, ["a"], "k", 3, posterior=True, label="b") for d in (df, df.repartition(9)))
    assert one.columns == ["k", "a", "b", "imputation"]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.filter("a IS NULL").isEmpty()


def test_weighted_sums_are_those_of_repeated_rows(spark):
    df, *_ = _half(spark)
    weights = [linear.poisson_draws(i, "k") for i in (1, 2)]
    for w, p in zip(weights, patterns.collect_weighted(df, ["a", "b"], weights), strict=True):
        repeated = df.withColumn("w", w).filter("w > 0").withColumn("w", F.explode(F.sequence(F.lit(1), "w")))
        want = patterns.collect(repeated, ["a", "b"], at=(p.center, p.scale))
        assert set(p.blocks) == set(want.blocks)
        for m, b in p.blocks.items():
            assert b.n == want.blocks[m].n and np.allclose(b.s, want.blocks[m].s, atol=1e-9) and np.allclose(b.q, want.blocks[m].q, atol=1e-9)


def test_lasso_errors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = 2 * x[:, 0] + rng.normal(size=600)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    lasso = linear.fit(df, ["a", "b", "c"], "y", l1=60.0)
    assert [c == 0 for c in lasso.coef] == [s is None for s in lasso.se[1:]] and lasso.coef[0] > 1
    near, ridge = linear.fit(df, ["a", "b", "c"], "y", l1=1e-6), linear.fit(df, ["a", "b", "c"], "y", l2=1e-6)
    assert np.allclose(near.se, ridge.se, rtol=1e-3)


@pytest.mark.parametrize("posterior", [False, True])
def test_pooling(spark, posterior):
    df, a, b, _ = _half(spark)

    def ols(d):
        t = d.agg(F.covar_pop("b", "a").alias("c"), F.var_pop("b").alias("v"), F.var_pop("a").alias("w"), F.count("*").alias("n")).first()
        return [("b", t.c / t.v, ((t.w - t.c**2 / t.v) / t.v / t.n) ** 0.5)]

    pooled = ensemble.impute_fit_pool(df, ["b"], "a", "k", ols, 4, posterior=posterior).first()
    assert abs(pooled.estimate - 0.8) < 0.2 and pooled.se > 0
