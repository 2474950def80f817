import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.functions import numerics
from lacuna.operators import diagnostics, ensemble, kernels, linear, logistic, mixed, neighbors, process, resampling, results
from lacuna.plans import gaussian, pivots
from lacuna.plans.patterns import Block, Patterns, collect
from lacuna.sources import ingest


def row_em(x, steps):
    """EM row by row, by the definition."""
    n, p = x.shape
    mu, sigma = np.nanmean(x, 0), np.diag(np.nanvar(x, 0))
    for _ in range(steps):
        filled, extra = x.copy(), np.zeros((p, p))
        for i in range(n):
            m, o = np.isnan(x[i]), ~np.isnan(x[i])
            k = sigma[np.ix_(m, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)])
            filled[i, m] = mu[m] + k @ (x[i, o] - mu[o])
            extra[np.ix_(m, m)] += sigma[np.ix_(m, m)] - k @ sigma[np.ix_(o, m)]
        mu = filled.mean(0)
        sigma = (filled - mu).T @ (filled - mu) / n + extra / n
    return mu, sigma


def blocks_of(x):
    out = {}
    for row in x:
        obs = np.flatnonzero(~np.isnan(row))
        key = "".join("0" if not np.isnan(v) else "1" for v in row)
        b = Block(obs, 1.0, row[obs], np.outer(row[obs], row[obs]))
        out[key] = out[key] + b if key in out else b
    return Patterns([f"c{j}" for j in range(x.shape[1])], np.zeros(x.shape[1]), np.ones(x.shape[1]), out)


def sample(n=400, p=3, rate=0.2, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(p, p))
    x = rng.normal(size=(n, p)) @ a
    x[rng.random(x.shape) < rate] = np.nan
    return x[~np.isnan(x).all(1)]


def test_em_on_blocks_equals_em_on_rows():
    x = sample()
    m = gaussian.em(blocks_of(x), 5000, 1e-15, 0.0)
    mu, sigma = row_em(x, 400)
    assert np.allclose(m.mu, mu, atol=1e-5) and np.allclose(m.sigma, sigma, atol=1e-4)


@given(st.integers(0, 1000))
@settings(max_examples=15, deadline=None)
def test_blocks_merge_by_addition_and_em_never_gets_worse(seed):
    x = sample(60, 3, 0.3, seed)
    both = blocks_of(x[:30]).merge(blocks_of(x[30:]))
    m = gaussian.em(both, 30, 0.0, 0.0)
    assert np.allclose(gaussian.loglik(both, m.mu, m.sigma), gaussian.loglik(blocks_of(x), m.mu, m.sigma))
    assert gaussian.loglik(both, m.mu, m.sigma) >= gaussian.em(both, 3, 0.0, 0.0).loglik - 1e-6


def test_tails_and_quadrature():
    assert abs(numerics.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(numerics.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-10
    assert abs(numerics.t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-10
    assert abs(numerics.t_two_sided(1.96, math.inf) - numerics.two_sided_p(1.96)) < 1e-15
    t = np.linspace(-60, 60, 400_001)
    for a, v in ((0.3, 0.0), (-1.0, 0.5), (2.0, 9.0), (0.0, 400.0)):
        want = numerics.sigmoid(np.array([a]))[0] if not v else (numerics.sigmoid(a + t * math.sqrt(v) / 6) * np.exp(-((t / 6) ** 2) / 2) / math.sqrt(2 * math.pi)).sum() * (t[1] - t[0]) / 6
        assert abs(numerics.logistic_normal(np.array([a]), np.array([v]))[0] - want) < 1e-5


def frame(spark, x, y, extra=()):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], None if np.isnan(t) else float(t), *[e[i] for e in extra]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    names = ", ".join(f"x{j} double" for j in range(x.shape[1]))
    return spark.createDataFrame(rows, f"k long, {names}, y double" + (", g long" if extra else ""))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 3))
    x[:, 1] += 0.5 * x[:, 0]
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=3000) * 0.5
    masked = x.copy()
    masked[rng.random(x.shape) < 0.2] = np.nan
    y[::10] = np.nan
    return frame(spark, masked, y).cache()


def test_linear_recovers_coefficients(data):
    m = linear.fit(data, ["x0", "x1", "x2"], "y")
    assert np.allclose([m.intercept, *m.coef], [1, 2, -1, 0], atol=0.06)
    assert all(s and 0.003 < s < 0.05 for s in m.se[1:])
    ridge = linear.fit(data, ["x0", "x1", "x2"], "y", l2=1e6, compute_se=False)
    assert np.abs(ridge.coef).max() < 0.1
    lasso = linear.fit(data, ["x0", "x1", "x2"], "y", l1=400.0, compute_se=False)
    assert abs(lasso.coef[2]) < 1e-3 < abs(lasso.coef[0])
    s = resampling.regression_scores(m.transform(data), "y", "prediction").first()
    assert s.r2 > 0.6
    inside = m.transform(data).filter("y IS NOT NULL").selectExpr("avg(CAST(y BETWEEN lo AND hi AS DOUBLE)) AS c").first().c
    assert 0.92 < inside < 0.98


def test_partitioning_does_not_matter(data):
    a = linear.fit(data, ["x0", "x1"], "y", compute_se=False)
    b = linear.fit(data.repartition(7), ["x0", "x1"], "y", compute_se=False)
    assert np.allclose(a.coef, b.coef, rtol=1e-6)


def test_logistic_recovers_coefficients(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < numerics.sigmoid(0.5 + 1.5 * x[:, 0])).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    df = frame(spark, x, y)
    m = logistic.fit(df, ["x0", "x1"], "y")
    assert np.allclose([m.intercept, *m.coef], [0.5, 1.5, 0.0], atol=0.15)
    p = m.transform(df).selectExpr("min(probability) AS a", "max(probability) AS b", "count(probability) AS n").first()
    assert 0 <= p.a <= p.b <= 1 and p.n == 4000


def test_mixed_recovers_components(spark):
    rng = np.random.default_rng(10)
    g = np.repeat(np.arange(60), 25)
    x = rng.normal(size=(1500, 1))
    y = 2 + 0.7 * x[:, 0] + rng.normal(size=60)[g] * 2 + rng.normal(size=1500)
    x[::9] = np.nan
    m = mixed.fit(frame(spark, x, y, (g.tolist(),)), ["x0"], "y", "g")
    assert abs(m.fixed.coef[0] - 0.7) < 0.12 and 2 < m.tau2 < 7 and abs(m.sigma2 - 1) < 0.25 and 0.6 < m.icc < 0.9
    blup = {r.g: r.blup for r in m.intercepts.collect()}
    assert len(blup) == 60 and np.isfinite(m.joint_loglik) and m.joint_loglik < m.loglik
    assert m.transform(frame(spark, x[:9], y[:9], ([*range(8), 999],))).filter("prediction IS NULL").isEmpty()


def test_imputation_and_sensitivity(data):
    done = linear.multiple_imputation(data, ["x0", "x1", "y"], "k", 3)
    assert done.count() == 9000 and done.filter("x0 IS NULL OR x1 IS NULL OR y IS NULL").isEmpty()
    again = linear.multiple_imputation(data.repartition(5), ["x0", "x1", "y"], "k", 3)
    a, b = (d.filter("k < 50").selectExpr("k", "imputation", "round(x0, 6) AS x0", "round(y, 6) AS y").orderBy("k", "imputation").collect() for d in (done, again))
    assert a == b
    curve = {r.delta_std: r.coef for r in ensemble.delta_sweep(data, ["x0"], "y", "k", 3, 5).filter("feature = 'x0'").collect()}
    assert len(curve) == 5 and abs(curve[0.0] - 1.5) < 0.15


def test_kernel_machines(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(-2, 2, size=(150, 2))
    y = np.sin(2 * x[:, 0]) + rng.normal(size=150) * 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    df = frame(spark, x, y)
    for m, least in ((process.fit(df, ["x0", "x1"], "y"), 0.7), (kernels.fit_support(df, ["x0", "x1"], "y", "regressor", c=10.0), 0.4)):
        assert resampling.regression_scores(m.transform(df), "y", "prediction").first().r2 > least
    b = df.withColumn("b", (df.y > 0).cast("int"))
    assert resampling.classification_scores(kernels.fit_support(b, ["x0", "x1"], "b").transform(b), "b", "probability").first().auc > 0.9


def test_refusals(spark, data):
    with pytest.raises(ValueError, match="no observed value in z"):
        linear.fit(data.selectExpr("*", "CAST(NULL AS DOUBLE) AS z"), ["x0", "z"], "y")
    with pytest.raises(ValueError, match="use a penalty"):
        linear.fit(data.limit(3), ["x0", "x1", "x2"], "y")
    with pytest.raises(ValueError, match="not in the table: nope"):
        ingest.coerce(data, ["nope"])
    with pytest.raises(TypeError):
        ingest.coerce(data.selectExpr("array(x0) AS a"), ["a"])
    with pytest.raises(ValueError, match="scoring"):
        resampling.cross_validate(data, "k", 2, lambda d: None, "y", scoring="nope")
    constant = linear.fit(data.selectExpr("*", "CAST(3 AS DOUBLE) AS c"), ["x0", "c"], "y")
    assert constant.coef[1] == 0 and constant.se[2] is None


def test_regimes(spark):
    """Degenerate shapes fit with a penalty and answer finite predictions."""
    rng = np.random.default_rng(13)
    for name, n, p, rate in (("half", 120, 5, 0.5), ("ninety", 120, 5, 0.9), ("wide", 25, 30, 0.1), ("tiny", 12, 3, 0.1), ("single", 120, 1, 0.2)):
        x = rng.normal(size=(n, p))
        y = x[:, 0] + rng.normal(size=n) * 0.4
        x[rng.random(x.shape) < rate] = np.nan
        df = frame(spark, x, y)
        m = linear.fit(df, [f"x{j}" for j in range(p)], "y", l2=1.0, compute_se=False)
        assert np.isfinite(m.coef).all(), name
        assert m.transform(df).filter("prediction IS NULL OR isnan(prediction)").isEmpty(), name


def test_nan_becomes_null_and_csv_reads_missing(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "a double")
    assert ingest.coerce(df, ["a"]).filter("a IS NULL").count() == 2
    (tmp_path / "t.csv").write_text("a,b\n1,\n,2\n")
    assert ingest.read_csv(spark, str(tmp_path / "t.csv"), "a double, b double").filter("a IS NULL OR b IS NULL").count() == 2
    ingest.write_results(df, str(tmp_path / "out"), "csv")
    assert collect(df.selectExpr("nanvl(a, NULL) AS a"), ["a"]).n == 3
    assert diagnostics.needs_copula(spark.range(100).selectExpr("exp(id / 10.0) AS a"), ["a"])


def test_stream_of_patterns(spark, tmp_path):
    from lacuna.streaming.pattern_stream import windowed_patterns

    t = spark.createDataFrame([(f"2024-01-0{d} 10:00:00", None if d % 2 else 1.0) for d in range(1, 8)], "t string, y double").selectExpr("CAST(t AS TIMESTAMP) AS ts", "y")
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = windowed_patterns(stream, ["y"]).writeStream.outputMode("complete").format("memory").queryName("patterns").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("patterns").collect())) == sorted(map(tuple, windowed_patterns(t, ["y"]).collect()))


def test_too_many_blocks_are_refused(spark, monkeypatch):
    """300 blocks of 150 groups and two patterns, where 200 blocks are allowed."""
    from lacuna.plans import patterns

    monkeypatch.setattr(patterns, "MAX_PATTERNS", 2)
    df = spark.createDataFrame([(g, None if i else float(g), float(g + i)) for g in range(150) for i in range(2)], "g int, a double, b double")
    with pytest.raises(ValueError, match="blocks"):
        patterns.collect(df, ["a", "b"], by=("g",))
    assert len(patterns.collect(df.filter("g < 100"), ["a", "b"], by=("g",))) == 100


def test_places_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    from lacuna.plans import ranks

    rng = np.random.default_rng(2)
    rows = [(i, None if i % 17 == 0 else float(rng.integers(0, 40)), f"s{i % 5}") for i in range(700)]
    df = spark.createDataFrame(rows, "k long, v double, s string")
    monkeypatch.setattr(ranks, "PART_ROWS", 50)
    got = ranks.numbered(df, [ranks.F.col("s"), ranks.F.col("v"), ranks.F.col("k")], "place").collect()
    want = sorted(rows, key=lambda r: (r[2], r[1] is not None, r[1] or 0.0, r[0]))
    assert [r.k for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in want]
    v = np.array([r[1] for r in rows if r[1] is not None])
    for r in ranks.ranked(df, "v").collect():
        assert r.c == (v == r.v).sum() and r.rank == (v < r.v).sum() + ((v == r.v).sum() + 1) / 2


def test_pooling_refuses_incomplete_imputations(spark):
    rows = [("a", 1.0, 0.5), ("a", 2.0, 0.5), ("b", 1.0, None), ("b", 2.0, 0.5), ("c", 1.0, 0.0), ("c", 2.0, 0.0), ("d", 1.0, 0.3), ("d", 1.0, 0.3), ("e", float("nan"), 0.3)]
    t = {r.feature: r for r in results.rubin(spark.createDataFrame(rows, "feature string, coef double, var double")).collect()}
    assert t["b"].m == 2 and t["b"].se is None and t["b"].df is None and t["e"].estimate is None
    assert t["a"].estimate == 1.5 and t["c"].df == 1.0 and math.isinf(t["d"].df)


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pivots, "QUERY_ROWS", 7)
    monkeypatch.setattr(pivots, "TRAIN_ROWS", 11)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (60, 2)).astype(float)
    df = spark.createDataFrame([(f"k{i:02}", *map(float, r), 0.25 * (i % 3)) for i, r in enumerate(x)], "k string, f0 double, f1 double, s double")
    got = neighbors.nearest(df.filter("k >= 'k20'"), df.filter("k < 'k20'"), "k", "k", 2, 4).collect()
    s = np.array([0.25 * (i % 3) for i in range(60)])
    for q in range(20):
        d = sorted((round(float(np.sqrt(((x[q] - x[t]) ** 2).sum() + s[q] + s[t])), 9), f"k{t:02}") for t in range(20, 60))[:4]
        assert [(r.d, r.k) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == f"k{q:02}"] == d
    with pytest.raises(ValueError, match="refused"):
        neighbors.gram(df, "k", 2, 0.1, limit=10)


def test_all_pairs_in_blocks(spark, monkeypatch):
    """More rows than a broadcast side was allowed, and many small blocks."""
    assert neighbors.paired(spark.range(5100).withColumnRenamed("id", "k"), "k").count() == 5100**2
    monkeypatch.setattr(neighbors, "PAIR_ROWS", 7)
    df = spark.range(61).selectExpr("id AS k", "id * 0.5D AS f0", "CASE WHEN id % 3 = 0 THEN 0.25D ELSE 0D END AS s")
    got = {(r.a, r.b): r.k for r in neighbors.gram(df, "k", 1, 0.1).collect()}
    s = [0.25 * (i % 3 == 0) for i in range(61)]
    assert len(got) == 61**2
    assert all(abs(v - (1.0 if a == b else math.exp(-0.1 * ((a - b) ** 2 / 4 + s[a] + s[b])))) < 1e-12 for (a, b), v in got.items())


@pytest.fixture(scope="module")
def exact(spark):
    """A label that two correlated features give without noise, x1 with gaps."""
    t = spark.range(2000).selectExpr("id AS k", "CAST(id * 7 % 50 + 1 AS DOUBLE) AS s", "900 + id % 1000 * 0.1D AS y")
    return t.selectExpr("k", "CASE WHEN k % 6 > 0 THEN s END AS x1", "s + 0.1D * y AS x2", "y").cache()


def test_exact_label_unpenalised(exact):
    """The likelihood has no maximum there: the fit ends at the relation, with the least spread."""
    m = linear.fit(exact.filter("x1 IS NOT NULL"), ["x1", "x2"], "y", compute_se=False)
    assert np.allclose([m.intercept, *m.coef], [0, -10, 10], atol=1e-5) and 0 < m.sigma2 < 1e-8


def test_exact_label_of_bagged_rows_with_gaps(exact):
    models = ensemble.bagged(exact, "k", lambda d: linear.fit(d, ["x1", "x2"], "y", l2=1.0, compute_se=False), 3)
    for m in models:
        assert np.allclose([m.intercept, *m.coef], [0, -10, 10], atol=1e-4) and 0 < m.sigma2 < 1e-8


def test_curvature_is_the_slope_of_the_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    a = np.column_stack([np.ones(300), x, x @ [1.0, -2.0] + rng.normal(size=300)])
    blocks = [(300.0, a.T @ a, np.zeros((2, 2))), (300.0, a.T @ a * 1.1, np.diag([0.2, 0.0]))]
    theta, eps = np.array([0.1, 0.9, -1.7, -0.5]), 1e-6
    slopes = [(linear.objective(blocks, theta + e, 1.0)[1] - linear.objective(blocks, theta - e, 1.0)[1]) / (2 * eps) for e in eps * np.eye(4)]
    assert np.allclose(linear.curvature(blocks, theta, 1.0), slopes, rtol=1e-6, atol=1e-4)


def test_pairs_are_not_replicated_by_a_shuffle(spark, monkeypatch):
    """A row is shuffled once, however many parts there are, and no side is broadcast."""
    monkeypatch.setattr(neighbors, "PAIR_ROWS", 7)
    df = spark.range(61).selectExpr("id AS k", "id * 0.5D AS f0", "0D AS s")
    for pairs in (neighbors.gram(df, "k", 1, 0.1), neighbors.paired(df, "k")):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan
        assert pairs.count() == 61**2


def test_equal_rows_meet_once(spark, monkeypatch):
    """A function of two rows is evaluated once for all their equals; keys and values may be null or NaN."""
    calls = spark.sparkContext.accumulator(0)

    def product(x, y):
        calls.add(1)
        return None if x is None or y is None else x * y

    df = spark.createDataFrame([(None if i == 5 else i, [0.5, 0.25, None, float("nan"), 1.0][i % 5]) for i in range(400)], "k long, x double")
    got = neighbors.over_pairs(df, "k", {"v": F.udf(product, "double")("x", "other_x")}).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 160_000
    value = {r.k: r.x for r in df.collect()}
    for r in got[::97]:
        want = product(value[r.a], value[r.b])
        assert r.v == want or (want != want and r.v != r.v)
    assert calls.value < 40_000


def test_rounding_of_kernels_equals_round(spark):
    rng = np.random.default_rng(3)
    values = [*rng.random(20_000), *(np.arange(2001) / 2e6), *(0.123456 + np.arange(-50, 51) * 1e-9), 0.0, 1.0, 0.9999995, 1e-300, float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    assert df.filter(~neighbors.rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6))).count() == 0


def test_triangles_in_blocks():
    rng = np.random.default_rng(4)
    low = np.tril(rng.normal(size=(11, 11))) + 4 * np.eye(11)
    b = rng.normal(size=(11, 3))
    assert np.allclose(low @ numerics.solve_lower(low, b, 4), b) and np.allclose(low.T @ numerics.solve_upper(low, b[:, 0], 4), b[:, 0])
    assert np.allclose(numerics.inverse_lower(low, 4) @ low, np.eye(11))


def test_process_classification_of_many_distinct_rows(spark, monkeypatch):
    """More distinct rows than exact regressions take, with gaps, in several tiles: the result of one tile."""
    monkeypatch.setattr(kernels, "MAX_ROWS", 20)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    rows = [(i, None if i % 6 == 0 else float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, x0 double, x1 double, y int")
    found = []
    for tile in (256, 13):
        monkeypatch.setattr(process, "TILE", tile)
        m = process.fit(df, ["x0", "x1"], "y", "classification", "matern52", restarts=0, steps=8)
        found.append((m.value, *m.posterior(x)[0]))
    assert len(m.rows) == 90 and np.allclose(*found, atol=1e-6)
    assert np.mean((m.posterior(x)[0] > 0) == (x.sum(1) > 0)) > 0.9
    scored = m.transform(df)
    assert scored.count() == 90 and scored.filter("probability BETWEEN 0 AND 1").count() == 90
