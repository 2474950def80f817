"""Ensembles, explanations, recommendation, benchmark arms and conformance on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import advise, arms, conformance, ensemble, explain, linear, resampling
from lacuna.operators.auto import Estimator


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 200
    x = rng.normal(size=(n, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n)
    gaps = rng.random((n, 3)) < 0.15
    rows = [(i, *[None if gaps[i, j] else float(x[i, j]) for j in range(3)], float(y[i]), int(y[i] > 0), "abc"[i % 3], i % 20) for i in range(n)]
    return spark.createDataFrame(rows, "k long, x1 double, x2 double, x3 double, y double, b int, c string, g int").cache()


X = ["x1", "x2", "x3"]


def brute_shapley(value, row):
    p = len(row)
    phi = np.zeros(p)
    for j in range(p):
        for n in range(p):
            for s in itertools.combinations([i for i in range(p) if i != j], n):
                w = math.factorial(n) * math.factorial(p - n - 1) / math.factorial(p)
                on, off = (np.array([row[i] if i in t else np.nan for i in range(p)]) for t in ({*s, j}, set(s)))
                phi[j] += w * (value(on) - value(off))
    return np.where(np.isnan(row), 0, phi)


def test_shapley_values_of_a_fitted_model(table):
    m = Estimator("linear").fit(table, X, "y")
    own = m.models[0]

    def value(r):
        obs, mis = np.flatnonzero(~np.isnan(r)), np.flatnonzero(np.isnan(r))
        mean = own.mu.copy()
        mean[obs] = r[obs]
        if len(obs):
            mean[mis] = own.mu[mis] + own.sigma[np.ix_(mis, obs)] @ np.linalg.solve(own.sigma[np.ix_(obs, obs)], r[obs] - own.mu[obs])
        return own.intercept + own.coef @ mean

    few = table.filter("k < 12")
    e = explain.fit(m, table, X)
    assert abs(e.expected - value(np.full(3, np.nan))) < 1e-9
    raw = {r.k: np.array([np.nan if r[c] is None else r[c] for c in X]) for r in few.collect()}
    got: dict = {}
    for r in e.shap(few, "k").collect():
        got.setdefault(r.k, np.zeros(3))[X.index(r.feature)] = r.phi
    near: dict = {}
    for r in e.shap(few, "k", "kernel").collect():
        near.setdefault(r.k, np.zeros(3))[X.index(r.feature)] = r.phi
    for k, r in raw.items():
        assert np.allclose(got[k], brute_shapley(value, r), atol=1e-9)
        assert abs(near[k].sum() - (value(r) - e.expected)) < 1e-6 and np.allclose(near[k], got[k], atol=0.5)
    cost = {(r.k, r.feature): r.phi for r in e.missing(few, "k").collect()}
    for k, r in raw.items():
        for j, c in enumerate(X):
            full, without = r.copy(), r.copy()
            obs = np.flatnonzero(~np.isnan(r))
            if np.isnan(r[j]):
                full[j] = e.mu[j] + (e.sigma[j, obs] @ np.linalg.solve(e.sigma[np.ix_(obs, obs)], r[obs] - e.mu[obs]) if len(obs) else 0)
            without[j] = np.nan
            assert abs(cost[k, c] - (value(full) - value(without))) < 1e-6
    values = e.shap(few, "k")
    assert explain.summary(values).count() == 3 and explain.export(values, few, "k", X, e.expected).count() == 36
    swarm = explain.beeswarm(values, "k", most=2).collect()
    assert len(swarm) == 24 and all(abs(r.jitter) <= 0.35 for r in swarm) and {r.place for r in swarm} == {1, 2}
    fall = explain.waterfall(values, "k", 3, e.expected, most=2).orderBy("place").collect()
    assert len(fall) == 2 and fall[-1].feature == "others" and abs(fall[-1].start - e.expected) < 1e-9 and abs(fall[0].end - value(raw[3])) < 1e-9
    assert explain.dependence(values, few, "k", "x1", "x2").count() == sum(not np.isnan(r[0]) for r in raw.values())
    assert [r.place for r in explain.missing_importance(e.missing(few, "k")).orderBy("place").collect()] == [1, 2, 3]


def test_explained_classes_and_neighbors(table):
    m = Estimator("neighbors").fit(table, X[:2], "c", key="k")
    phi = explain.fit(m, table, X[:2], value="a").shap(table.filter("k < 5"), "k").collect()
    assert len(phi) == 10 and all(math.isfinite(r.phi) for r in phi)
    b = Estimator("bayes").fit(table, X[:2], "b")
    assert explain.output(b, "log-odds")[0] == "log-odds"
    with pytest.raises(ValueError):
        explain.output(b, "proba", 7)


def test_bagging(table):
    m = ensemble.Bagging([Estimator("ridge"), Estimator("bayes")], 6, 0.7, oob=True, seed=3).fit(table, X, "y", "k")
    assert {len(s) for s in m.subsets} == {2} and len({tuple(s) for s in m.subsets}) > 1
    out = m.transform(table).collect()
    assert len(out) == 200 and all(r.lo <= r.prediction + 1e-9 and r.prediction <= r.hi + 1e-9 for r in out)
    scores = m.oob_scores().first()
    assert 150 < scores.n <= 200 and scores.r2 > 0.3
    assert abs(sum(v for _, v, _ in m.importances()) - 1) < 1e-6
    c = ensemble.Bagging([Estimator("bayes", task="classification")], 4, weights=[1, 1, 2, 0], cluster="g", oob=True).fit(table, X, "b", "k")
    assert c.weights == [0.25, 0.25, 0.5, 0.0] and c.transform(table).filter("b = prediction").count() > 150
    drawn = ensemble.bag_weights(table, "k", 1, 0, "g", keep_copy=True)
    per = drawn.groupBy("g", "_copy").count().collect()
    assert len({r["count"] for r in per}) == 1 and any("__b2" in r.g for r in per)
    probabilities = table.limit(1).select(ensemble.aligned(F.array(F.lit(0.25), F.lit(0.75)), ["b", "c"], ["a", "b", "c"]).alias("p")).first().p
    assert probabilities == [0.0, 0.25, 0.75]
    for bad in (lambda: ensemble.normal_weights([1, -1], 2), lambda: ensemble.normal_weights([1], 2), lambda: ensemble.Bagging([Estimator("linear")], 2).fit(table, X, "c", "k"), lambda: ensemble.Bagging(["tree"], 2).fit(table, X, "y", "k")):
        with pytest.raises((ValueError, TypeError)):
            bad()


def test_cross_validation_by_groups_and_metrics(table):
    t = resampling.cross_validate_metrics(table, "k", 3, lambda d: Estimator("bayes").fit(d, X, "b"), "b", ("accuracy", "roc_auc"), group="g", train_scores=True).collect()
    assert len(t) == 6 and all(0 <= r.test <= 1 and 0 <= r.train <= 1 and r.seconds > 0 for r in t)
    failed = resampling.cross_validate_metrics(table, "k", 2, lambda d: Estimator("linear").fit(d.limit(1), X, "y"), "y", ("r2",)).collect()
    assert [r.test for r in failed] == [None, None]
    with pytest.raises(ValueError):
        resampling.cross_validate_metrics(table, "k", 2, None, "y", ("r3",))


def test_sensitivity_and_pooling(table):
    gaps = table.withColumn("y", F.when(F.col("k") % 5 > 0, F.col("y")))
    curve = ensemble.delta_sweep(gaps, X[:2], "y", "k", imputations=3, deltas=7)
    wide = ensemble.sensitivity_table(curve)
    assert wide.count() == 7 and set(wide.columns) == {"delta_std", "x1_coef", "x1_se", "x2_coef", "x2_se"}
    s = {r.feature: r for r in ensemble.sensitivity_summary(curve).collect()}
    assert s["x1"].least <= s["x1"].coef <= s["x1"].greatest and s["x1"].verdict in ("ROBUST", "MILD", "SENSITIVE")

    def ols(d):
        return [(r.feature, r.coef, r.se) for r in linear.fit(d, X[:2], "y").coefficients(d.sparkSession).collect()]

    pooled = {r.feature: r for r in ensemble.impute_fit_pool(gaps, X[:2], "y", "k", ols, 3).collect()}
    assert abs(pooled["x1"].estimate - 2) < 0.4 and pooled["x1"].se > 0 and pooled["x1"].m == 3


def test_recommendation_follows_the_data(table, spark):
    straight = advise.recommend(table, X, "y", "k")
    rank = straight.ranking.collect()
    assert straight.family == "linear" and len(rank) == 8 and {r.family for r in rank if r.vetoed} == {"mixed"}
    row = straight.evidence.first()
    assert row.has_skill and row.ratio < 0.9 and row.n == 200 and row.p == 3 and 0.1 < row.cell_rate < 0.2
    assert straight.estimator().fit(table, X, "y").task == "regression"
    assert straight.summary().count() == 4 and straight.advice.filter("kind = 'drop' AND wanted").count() == 0
    bent = table.withColumn("y", F.sin(3 * F.coalesce("x1", F.lit(0.0))))
    assert advise.recommend(bent, X[:1], "y", "k").family in ("neighbors", "support", "process")
    grouped = advise.recommend(table.withColumn("y", F.col("y") + 3 * (F.col("g") % 4)), X, "y", "k", group="g")
    assert grouped.family == "mixed" and grouped.evidence.first().icc > 0.05
    sparse = table.withColumn("x3", F.when(F.col("k") % 10 == 0, F.col("x3")))
    assert [r.item for r in advise.recommend(sparse, X, "c", "k").advice.filter("kind = 'drop' AND wanted").collect()] == ["x3"]


def test_arms(table):
    scores = arms.run_folds(table, X, "y", "k", folds=2)
    t = {(r.arm, r.metric): r for r in arms.table(scores).collect()}
    assert {a for a, _ in t} == set(arms.ARMS) and t["model", "r2"]["mean"] > 0.6
    assert t["drop_columns", "r2"].n == 0 and all(t[a, "r2"].n == 2 for a in arms.ARMS if a != "drop_columns")
    assert arms.tests_against(scores, "r2").count() == 4
    filled = arms.fill_neighbors(table, table, X, "k").select(*X)
    assert filled.dropna().count() == 200
    run = arms.iterated(table, X, 3)
    assert run(table).select(*X).dropna().count() == 200 and run(table).columns == table.columns
    clf = arms.run_folds(table, X[:2], "b", "k", "classification", 2, arms=("mean", "model"), family="bayes")
    assert arms.table(clf).filter("metric = 'auc' AND mean > 0.8").count() == 2
    swept = arms.sweep(table, X[:2], "y", "k", (0.1, 0.4), folds=2, arms=("mean", "model"))
    assert arms.degradation(swept, "r2").count() == 4
    assert arms.matched_strength(table, X, "y", "k") in arms.GRID
    made = arms.generated(table.sparkSession, 300, 5)
    hidden = made.select(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in ("x1", "x3", "x5", "y")]).first()
    assert 0.2 < hidden.x1 < 0.6 and hidden.x5 == hidden.y == 0


@pytest.mark.parametrize(("family", "task"), [("linear", "regression"), ("bayes", "classification")])
def test_degenerate_tables(spark, family, task):
    names = ("missing_90", "no_complete_row", "empty_column", "constant", "tiny", "missing_outcome", "one_observed_cell", "blockwise")
    assert set(names) < set(conformance.regimes(task))
    report = conformance.check(spark, Estimator(family, task), task, names).cache()
    rows = {r.regime: r for r in report.collect()}
    assert not conformance.problems(report).collect(), rows
    assert rows["empty_column"].outcome == "refused clearly" and "x3" in rows["empty_column"].detail
    assert sum(r.outcome == "fitted" for r in rows.values()) >= 6


def test_fits_do_not_depend_on_the_order_of_rows(table):
    t = conformance.deterministic(table, "k", lambda d: Estimator("ridge").fit(d, X, "y")).collect()
    assert len(t) == 2 and all(r.same for r in t)


def test_neighbour_filling_sends_no_table_through_the_driver(spark):
    df = spark.range(400).selectExpr("id AS k", "if(id % 5 = 0, NULL, cast(id % 37 as double)) AS a", "cast(id % 11 as double) AS b")
    filled = arms.fill_neighbors(df, df, ["a", "b"], "k")
    assert "BroadcastHashJoin" not in filled._jdf.queryExecution().executedPlan().toString()
    assert filled.count() == 400 and filled.filter("a IS NULL").count() == 0
