"""Queries on fitted models, predictions and workflows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lacuna.catalog.diagnose import query
from lacuna.functions import exprs
from lacuna.functions.numerics import gauss_hermite, normal_quantile
from lacuna.operators import bayes, linear, neighbors, resampling, results, workflow
from lacuna.plans import gaussian
from lacuna.plans.patterns import collect

Z = normal_quantile(0.975)


@query("m_part", "SELECT k, round((x1 - avg(x1) OVER ()) / stddev_samp(x1) OVER (), 5) AS x1, round((x2 - avg(x2) OVER ()) / stddev_samp(x2) OVER (), 5) AS x2 FROM {v}")
def standardise(df):
    return workflow.standardise(df, ["x1", "x2"], ("k",)).select("k", F.round("x1", 5).alias("x1"), F.round("x2", 5).alias("x2"))


@query("m_part", """
WITH r AS (SELECT k, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2 AS r, count(*) OVER () AS n FROM {v} WHERE x1 IS NOT NULL)
SELECT v.k, round((r - 0.375) / (n + 0.25), 6)::DOUBLE AS u FROM {v} v LEFT JOIN r ON v.k = r.k""")
def copula_plot_positions(df):
    return workflow.plot_positions(df, "k", "x1").withColumn("u", F.round("u", 6))


@query("m_part", """
WITH c AS (SELECT regr_slope(y, x2) AS b, avg(y) FILTER (y IS NOT NULL) AS my, avg(x2) FILTER (y IS NOT NULL) AS mc, var_pop(y) AS vy, var_pop(x2) FILTER (y IS NOT NULL) AS vc, avg(x2) AS mx, var_pop(x2) AS vx FROM {v})
SELECT round(mx, 3) AS mu_x, round(my + b * (mx - mc), 3) AS mu_y, round(vx, 2) AS var_x, round(b * vx, 2) AS cov, round(vy + b * b * (vx - vc), 2) AS var_y FROM c""")
def fiml_mean_monotone(df):
    p = collect(df, ["x2", "y"])
    mu, sigma = gaussian.raw_moments(p, gaussian.em(p, 5000, 1e-14, 0.0))
    row = (round(float(mu[0]), 3), round(float(mu[1]), 3), round(float(sigma[0, 0]), 2), round(float(sigma[0, 1]), 2), round(float(sigma[1, 1]), 2))
    return df.sparkSession.createDataFrame([row], "mu_x double, mu_y double, var_x double, cov double, var_y double")


@query("m_part", """
SELECT round(sum(CASE WHEN x1 IS NOT NULL AND y IS NOT NULL THEN -ln(2 * pi()) - 0.5 * ln(200 * 400 - 900) - 0.5 * (400 * pow(x1 - 25, 2) - 2 * 30 * (x1 - 25) * (y - 1400) + 200 * pow(y - 1400, 2)) / (200 * 400 - 900)
  WHEN x1 IS NOT NULL THEN -0.5 * ln(2 * pi() * 200) - 0.5 * pow(x1 - 25, 2) / 200 WHEN y IS NOT NULL THEN -0.5 * ln(2 * pi() * 400) - 0.5 * pow(y - 1400, 2) / 400 ELSE 0 END), 1) AS loglik FROM {v}""")
def fiml_loglik_p2(df):
    p = collect(df, ["x1", "y"])
    mu = (np.array([25.0, 1400.0]) - p.center) / p.scale
    sigma = np.array([[200.0, 30.0], [30.0, 400.0]]) / np.outer(p.scale, p.scale)
    shift = sum(b.n * np.log(p.scale[b.obs]).sum() for b in p.blocks.values())
    return df.sparkSession.createDataFrame([(round(float(gaussian.loglik(p, mu, sigma) - shift), 1),)], "loglik double")


REG = "WITH c AS (SELECT regr_slope(x1, x2) AS b, regr_intercept(x1, x2) AS a, var_pop(x1) * (1 - pow(corr(x1, x2), 2)) AS v FROM {v} WHERE x1 IS NOT NULL)"


@query("m_part", REG + " SELECT k, round(CASE WHEN x1 IS NOT NULL THEN x1 ELSE a + b * x2 END, 3) AS x1 FROM {v}, c")
def cond_mean_impute(df):
    return linear.conditional_mean_imputation(df, ["x1", "x2"], 1e-14, 0.0).select("k", F.round("x1", 3).alias("x1"))


@query("m_part", REG + " SELECT k, round(coalesce(x1, a + b * x2), 3) AS f, round(CASE WHEN x1 IS NULL THEN v ELSE 0 END, 3) AS s FROM {v}, c")
def expected_moments(df):
    p = collect(df, ["x1", "x2"])
    mu, sigma = gaussian.raw_moments(p, gaussian.em(p, 5000, 1e-14, 0.0))
    rows = neighbors.expected(df, ["x1", "x2"], ("k",), [0.0, 0.0], [1.0, 1.0], mu, sigma)
    return rows.select("k", F.round("f0", 3).alias("f"), F.round("s", 3).alias("s"))


OLS = "WITH c AS (SELECT regr_slope(y, x2) AS b, regr_intercept(y, x2) AS a, var_pop(y) * (1 - pow(corr(y, x2), 2)) AS v, regr_r2(y, x2) AS r2, count(y) AS n FROM {v} WHERE y IS NOT NULL)"


@query("m_part", OLS + " SELECT n, round(b, 4) AS slope, round(a, 2) AS intercept, round(v, 1) AS sigma2, round(r2, 5) AS r2 FROM c")
def linear_complete(df):
    m = linear.fit(df, ["x2"], "y", compute_se=False)
    s = resampling.regression_scores(m.transform(df), "y", "prediction")
    return s.select("n", F.lit(round(float(m.coef[0]), 4)).alias("slope"), F.lit(round(m.intercept, 2)).alias("intercept"), F.lit(round(m.sigma2, 1)).alias("sigma2"), F.round("r2", 5).alias("r2"))


@query("m_part", OLS + f" SELECT k, round(a + b * x2, 2) AS prediction, round(a + b * x2 - {Z!r} * sqrt(v), 2) AS lo, round(a + b * x2 + {Z!r} * sqrt(v), 2) AS hi FROM {{v}}, c")
def linear_predict_interval(df):
    m = linear.fit(df, ["x2"], "y", compute_se=False)
    return m.transform(df).select("k", *[F.round(c, 2).alias(c) for c in ("prediction", "lo", "hi")])


COEFS = [("a", 1.5, 0.5), ("b", -0.25, 0.1), ("c", 0.0, 0.2), ("d", 2.0, None)]


@query("m_part", f"""
WITH t AS (SELECT * FROM (VALUES ('a', 1.5::DOUBLE, 0.5::DOUBLE), ('b', -0.25, 0.1), ('c', 0.0, 0.2), ('d', 2.0, NULL)) t(feature, coef, se))
SELECT feature, coef, se, round(coef / se, 6) AS z, round(coef - {Z!r} * se, 6) AS lo, round(coef + {Z!r} * se, 6) AS hi, round(abs(coef) / sum(abs(coef)) OVER (), 6) AS importance FROM t""")
def coef_table(df):
    t = results.coefficient_table(df.sparkSession.createDataFrame(COEFS, "feature string, coef double, se double"))
    return t.select("feature", "coef", "se", *[F.round(c, 6).alias(c) for c in ("z", "lo", "hi", "importance")])


@query("m_part", """
WITH s AS (SELECT avg(y) AS my, var_samp(y) AS vy, covar_samp(x1, y) / var_samp(y) FILTER (x1 IS NOT NULL) AS b1, covar_samp(x2, y) / var_samp(y) FILTER (x2 IS NOT NULL) AS b2,
  avg(x1) AS m1, avg(y) FILTER (x1 IS NOT NULL) AS y1, var_samp(x1) AS v1, var_samp(y) FILTER (x1 IS NOT NULL) AS w1, avg(x2) AS m2, avg(y) FILTER (x2 IS NOT NULL) AS y2, var_samp(x2) AS v2, var_samp(y) FILTER (x2 IS NOT NULL) AS w2 FROM {v} WHERE y IS NOT NULL),
m AS (SELECT my, vy, b1, b2, m1 - b1 * y1 AS a1, m2 - b2 * y2 AS a2, (v1 - b1 * b1 * w1) * (1 + 1e-9) AS t1, (v2 - b2 * b2 * w2) * (1 + 1e-9) AS t2 FROM s)
SELECT k, round((my / vy + coalesce(b1 / t1 * (x1 - a1), 0) + b2 / t2 * (x2 - a2)) / (1 / vy + CASE WHEN x1 IS NULL THEN 0 ELSE b1 * b1 / t1 END + b2 * b2 / t2), 2) AS prediction,
  round(1 / sqrt(1 / vy + CASE WHEN x1 IS NULL THEN 0 ELSE b1 * b1 / t1 END + b2 * b2 / t2), 3) AS sd FROM {v}, m""")
def bayes_reg_naive(df):
    m = bayes.fit_regressor(df, ["x1", "x2"], "y", "naive")
    return m.transform(df).select("k", F.round("prediction", 2).alias("prediction"), F.round("sd", 3).alias("sd"))


@query("m_customer", """
WITH a AS (SELECT var_samp(x1) AS v1, var_samp(y) AS v2 FROM {v}), s AS (SELECT g, count(*) AS n, avg(x1) AS m1, var_samp(x1) AS w1, avg(y) AS m2, var_samp(y) AS w2 FROM {v} GROUP BY 1),
t AS (SELECT g, ln(n / sum(n) OVER ()) AS lp, m1, w1 + 1e-9 * v1 AS w1, m2, w2 + 1e-9 * v2 AS w2 FROM s, a),
l AS (SELECT k, t.g AS g, lp + CASE WHEN x1 IS NULL THEN 0 ELSE -0.5 * (ln(2 * pi() * w1) + pow(x1 - m1, 2) / w1) END + CASE WHEN y IS NULL THEN 0 ELSE -0.5 * (ln(2 * pi() * w2) + pow(y - m2, 2) / w2) END AS l FROM {v} v, t)
SELECT k, arg_max(g, l) AS prediction, round(1 / sum(exp(l - m)), 5) AS confidence FROM (SELECT *, max(l) OVER (PARTITION BY k) AS m FROM l) GROUP BY k""")
def bayes_clf_naive(df):
    m = bayes.fit_classifier(df, ["x1", "y"], "g")
    return m.transform(df).select("k", "prediction", F.round(F.array_max("probabilities"), 5).alias("confidence"))


def _hermite_sql() -> str:
    t, w = gauss_hermite(20)
    return " + ".join(f"{b!r} / (1 + exp(-(a + sqrt(v) * {c!r})))" for c, b in zip(t.tolist(), w.tolist(), strict=True))


@query("m_part", f"SELECT k, round(CASE WHEN v <= 1e-12 THEN 1 / (1 + exp(-a)) ELSE {_hermite_sql()} END, 8) AS p FROM (SELECT k, (k % 13 - 6) / 2.0::DOUBLE AS a, (k % 5) / 4.0::DOUBLE AS v FROM {{v}})")
def logistic_integral(df):
    a, v = (F.col("k") % 13 - 6) / F.lit(2.0), (F.col("k") % 5) / F.lit(4.0)
    return df.select("k", F.round(exprs.logistic_normal(a, v), 8).alias("p"))


KNN = """
WITH m AS (SELECT avg(x2) AS m2, stddev_samp(x2) AS s2, avg(x1) AS m1, stddev_samp(x1) AS s1 FROM {v}),
c AS (SELECT regr_slope(x1, x2) AS b, regr_intercept(x1, x2) AS a, var_pop(x1) * (1 - pow(corr(x1, x2), 2)) AS v FROM {v} WHERE x1 IS NOT NULL),
f AS (SELECT k, y, g, (coalesce(x1, a + b * x2) - m1) / s1 AS f0, (x2 - m2) / s2 AS f1, CASE WHEN x1 IS NULL THEN v / (s1 * s1) ELSE 0 END AS s FROM {v}, m, c),
d AS (SELECT q.k AS query, t.k AS k, t.y, t.g, round(sqrt(pow(q.f0 - t.f0, 2) + pow(q.f1 - t.f1, 2) + q.s + t.s), 5) AS d FROM f q JOIN f t ON q.y IS NULL AND t.y IS NOT NULL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, k) AS r FROM d) WHERE r <= 5),
w AS (SELECT *, CASE WHEN min(d) OVER (PARTITION BY query) = 0 THEN (d = 0)::INT ELSE 1 / d END AS w FROM n)
"""


def _knn(df):
    center, scale, *_ = neighbors.moments(df, ["x1", "x2"])
    p = collect(df, ["x1", "x2"])
    m = gaussian.em(p, 5000, 1e-14, 0.0)
    rows = neighbors.expected(df, ["x1", "x2"], ("k", "y", "g"), center, scale, m.mu, m.sigma)
    return neighbors.nearest(rows.filter("y IS NOT NULL"), rows.filter("y IS NULL"), "k", "k", 2, 5, digits=5)


@query("m_part", KNN + "SELECT query, round(sum(w * y) / sum(w), 2) AS prediction FROM w GROUP BY 1")
def knn_reg(df):
    return neighbors.predict(_knn(df), df, "k", "y").select("query", F.round("prediction", 2).alias("prediction"))


@query("m_part", KNN + "SELECT query, g AS class, round(sum(w) / sum(sum(w)) OVER (PARTITION BY query), 5) AS share FROM w GROUP BY query, g")
def knn_clf(df):
    return neighbors.class_shares(_knn(df), df, "k", "g").select("query", "class", F.round("share", 5).alias("share"))


SUPPLIER = "(SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 >= 1 THEN s_acctbal / 1000 ELSE 4.5 END AS f0, s_nationkey / 10 AS f1, CASE WHEN s_suppkey % 5 >= 1 THEN 0.0::DOUBLE ELSE 8.0 END AS s FROM supplier)"


def _supplier(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    seen = F.col("s_suppkey") % 5 >= 1
    return t.select(F.col("s_suppkey").alias("k"), F.when(seen, F.col("s_acctbal") / 1000).otherwise(4.5).alias("f0"), (F.col("s_nationkey") / 10).alias("f1"), F.when(seen, 0.0).otherwise(8.0).alias("s"))


def _rbf_gram(spark, sf_dir):
    return neighbors.gram(_supplier(spark, sf_dir), "k", 2, 0.1, digits=6)


def _gp_kernel(spark, sf_dir):
    r = F.col("f1") - F.col("other_f1")
    return neighbors.over_pairs(_supplier(spark, sf_dir).select("k", "f1"), "k", {k: neighbors.kernel_1d(r, k) for k in ("rbf", "matern52", "matern12")}, digits=6)


@query("m_orders", "WITH m AS (SELECT avg(y_grp) AS m FROM {v}) SELECT g, count(y_grp) AS n, round(4 * sum(y_grp - m) / (1 + 4 * count(y_grp)), 6) AS blup FROM {v}, m WHERE y_grp IS NOT NULL GROUP BY g")
def blup_re(df):
    mean = df.agg(F.avg("y_grp")).first()[0]
    return workflow.blups(df, "y_grp", "g", float(mean), 4.0, 1.0).withColumn("blup", F.round("blup", 6))


@query("m_customer", """
WITH s AS (SELECT k, c AS class, (k * (c + 3)) % 7 AS score FROM {v}, (VALUES (0), (1), (2)) t(c)), t AS (SELECT k, class, CASE WHEN sum(score) OVER (PARTITION BY k) > 0 THEN score / sum(score) OVER (PARTITION BY k) ELSE 1 / 3 END AS p FROM s)
SELECT k, class, round(p, 6)::DOUBLE AS probability, row_number() OVER (PARTITION BY k ORDER BY p DESC, class) = 1 AS chosen FROM t""")
def ovr_normalise(df):
    s = df.select("k", F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("class")).withColumn("score", (F.col("k") * (F.col("class") + 3)) % 7)
    return results.one_vs_rest(s, "k").select("k", "class", F.round("probability", 6).alias("probability"), "chosen")


@query("m_part", """
WITH s AS (SELECT k, m, x2 * (1 + (m * (k % 7 + 1)) % 11 / 100) AS p FROM {v}, range(1, 8) t(m))
SELECT k, round(sum(m * p) / sum(m), 8) AS prediction, round(quantile_cont(p, 0.025), 8) AS lo, round(quantile_cont(p, 0.975), 8) AS hi FROM s GROUP BY k""")
def ensemble_combine(df):
    s = df.select("k", "x2", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("weight"))
    s = s.withColumn("prediction", F.col("x2") * (1 + (F.col("weight") * (F.col("k") % 7 + 1)) % 11 / 100))
    return results.combine_members(s, "k").select("k", *[F.round(c, 8).alias(c) for c in ("prediction", "lo", "hi")])


@query("m_customer", """
WITH n AS (SELECT count(*) AS n FROM {v}), p AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos FROM {v}),
d AS (SELECT DISTINCT m AS member, (m * 7919 + i * 104729 + (i * i) % 8191) % n AS pos FROM n, range(0, 3) t(m), (SELECT unnest(range(0, n)) AS i FROM n))
SELECT m AS member, p.k FROM range(0, 3) t(m), p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.member = m AND d.pos = p.pos)""")
def bootstrap_oob(df):
    n = df.count()
    drawn = resampling.bootstrap(df, "k", n, 3, lambda m, i: (m * 7919 + i.cast("long") * 104729 + (i.cast("long") * i.cast("long")) % 8191) % n)
    return resampling.out_of_bag(df, "k", drawn, 3)


@query("m_customer", "SELECT k, (ntile(5) OVER (ORDER BY k) - 1)::INT AS fold FROM {v}")
def kfold(df):
    return resampling.kfold(df.select("k"), "k", 5)


@query("m_customer", "SELECT k, ((row_number() OVER (PARTITION BY g ORDER BY k) - 1) % 4)::INT AS fold FROM {v}")
def stratified_kfold(df):
    return resampling.stratified_kfold(df.select("k", "g"), "k", "g", 4).select("k", "fold")


@query("m_part", """
SELECT count(*) AS n, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM (SELECT y, 900 + 4 * x2 AS p FROM {v}) WHERE y IS NOT NULL""")
def cv_scores_regression(df):
    s = resampling.regression_scores(df.withColumn("p", 900 + 4 * F.col("x2")), "y", "p")
    return s.select("n", F.round("r2", 5).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("m_lineitem", """
WITH s AS (SELECT y_bin AS y, 1 / (1 + exp(-((x1 - 24) / 4))) AS p FROM {v} WHERE y_bin IS NOT NULL AND x1 IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s)
SELECT count(*) AS n, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(2 * count(*) FILTER (p >= 0.5 AND y = 1) / (2 * count(*) FILTER (p >= 0.5 AND y = 1) + count(*) FILTER (p >= 0.5 AND y = 0) + count(*) FILTER (p < 0.5 AND y = 1)), 6) AS f1,
  round(avg(pow(p - y, 2)), 6) AS brier, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def cv_scores_classification(df):
    s = resampling.classification_scores(df.withColumn("p", 1 / (1 + F.exp(-((F.col("x1") - 24) / 4)))), "y_bin", "p")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "brier", "auc")])


@query("m_lineitem", """
WITH s AS (SELECT y_bin AS y, (1 / (1 + exp(-((x1 - 24) / 4))) >= 0.5)::INT AS p FROM {v} WHERE y_bin IS NOT NULL AND x1 IS NOT NULL),
f AS (SELECT c, count(*) FILTER (y = c) AS n, 2 * count(*) FILTER (y = c AND p = c) / (count(*) FILTER (y = c) + count(*) FILTER (p = c)) AS f FROM s, (SELECT unnest([0, 1]) AS c) GROUP BY c)
SELECT round(sum(n * f) / sum(n), 6) AS f1_weighted, (SELECT round(avg(pow(y - p, 2)), 6) FROM s) AS mse FROM f""")
def cv_scores_weighted(df):
    """Weighted F1 of two classes, and the squared error of their predictions."""
    rows = df.withColumn("p", 1 / (1 + F.exp(-((F.col("x1") - 24) / 4))))
    f1 = resampling.classification_scores(rows, "y_bin", "p").select(F.round("f1_weighted", 6).alias("f1_weighted"))
    hit = rows.filter("y_bin IS NOT NULL AND x1 IS NOT NULL").withColumn("p", (F.col("p") >= 0.5).cast("int"))
    return f1.crossJoin(resampling.regression_scores(hit, "y_bin", "p").select(F.round("mse", 6).alias("mse")))  # one row each


@query("m_part", "WITH d AS (SELECT g, avg(x2) / 100 - avg(y) / 1000 AS d FROM {v} GROUP BY g) SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM d")
def paired_t(df):
    a, b = (df.groupBy(F.col("g").alias("fold")).agg((F.avg(c) / s).alias("score")) for c, s in (("x2", 100), ("y", 1000)))
    t = results.paired_t(a, b)
    return t.select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("sd_diff", 6).alias("sd_diff"), F.round("t", 4).alias("t"))


DRAW = "((k * 7919 + 13) % 1000) / 1000"


def _draw():
    return ((F.col("k") * 7919 + 13) % 1000) / F.lit(1000.0)


@query("m_part", f"SELECT k, CASE WHEN NOT {DRAW} < 0.25 THEN x2 END AS x2 FROM {{v}}")
def inject_mcar(df):
    return workflow.inject_mcar(df, "x2", 0.25, _draw()).select("k", "x2")


@query("m_part", f"WITH m AS (SELECT quantile_cont(y, 0.5) AS m FROM {{v}}) SELECT k, CASE WHEN NOT {DRAW} < CASE WHEN y > m THEN 4 / 3 * 0.25::DOUBLE ELSE 2 / 3 * 0.25::DOUBLE END THEN x2 END AS x2 FROM {{v}}, m")
def inject_mar(df):
    return workflow.inject_by_median(df, "x2", "y", 0.25, _draw()).select("k", "x2")


@query("m_part", f"WITH m AS (SELECT quantile_cont(x2, 0.5) AS m FROM {{v}}) SELECT k, CASE WHEN NOT {DRAW} < CASE WHEN x2 > m THEN 4 / 3 * 0.25::DOUBLE ELSE 2 / 3 * 0.25::DOUBLE END THEN x2 END AS x2 FROM {{v}}, m")
def inject_mnar(df):
    return workflow.inject_by_median(df, "x2", "x2", 0.25, _draw()).select("k", "x2")


@query("m_part", "SELECT k, x1, x2 FROM {v} WHERE x1 IS NOT NULL AND x2 IS NOT NULL")
def baseline_drop_rows(df):
    return workflow.drop_rows(df.select("k", "x1", "x2"), ["x1", "x2"])


@query("m_part", "SELECT k, x2 FROM {v}")
def baseline_drop_cols(df):
    return df.select("k", *workflow.complete_columns(df, ["x1", "x2"]))


@query("m_part", "SELECT k, round(coalesce(x1, avg(x1) OVER ()), 5) AS x1 FROM {v}")
def baseline_mean(df):
    return workflow.fill_means(df, ["x1"]).select("k", F.round("x1", 5).alias("x1"))


@query("m_part", "SELECT g AS dataset, min(r) FILTER (r / 100 > (k % 9) / 20) AS rate FROM {v}, range(5, 50, 5) t(r) GROUP BY g")
def sweep_crossover(df):
    s = df.select(F.col("g").alias("dataset"), ((F.col("k") % 9) / 20).alias("baseline"), F.explode(F.sequence(F.lit(5).cast("long"), F.lit(45).cast("long"), F.lit(5).cast("long"))).alias("rate"))
    return workflow.crossover(s.withColumn("ours", F.col("rate") / 100))


@query("m_part", """
WITH e AS (SELECT g AS feature, k % 2 AS m, avg(x2) AS coef, var_samp(x2) / count(*) AS var FROM {v} GROUP BY 1, 2), c AS (SELECT feature, count(*) AS m, count(var) AS fine, avg(coef) AS estimate, avg(var) AS w, coalesce(var_samp(coef), 0) AS b FROM e GROUP BY 1),
t AS (SELECT feature, m, CASE WHEN fine = m THEN estimate END AS estimate, CASE WHEN fine = m THEN w END AS w, CASE WHEN fine = m THEN b END AS b FROM c)
SELECT feature, m, round(estimate, 7) AS estimate, round(w, 7) AS within, round(b, 7) AS between, CASE WHEN w + (1 + 1 / m) * b > 0 THEN round(sqrt(w + (1 + 1 / m) * b), 7) END AS se,
  CASE WHEN w = 0 THEN CASE WHEN b > 0 THEN m - 1 ELSE 'inf'::DOUBLE END WHEN b > 0 THEN round((m - 1) * pow(1 + w / ((1 + 1 / m) * b), 2), 5) WHEN b = 0 THEN 'inf'::DOUBLE END AS df FROM t""")
def rubin_pool(df):
    e = df.groupBy(F.col("g").alias("feature"), (F.col("k") % 2).alias("imputation")).agg(F.avg("x2").alias("coef"), (F.var_samp("x2") / F.count("*")).alias("var"))
    t = results.rubin(e)
    return t.select("feature", "m", F.round("estimate", 7).alias("estimate"), F.round("within", 7).alias("within"), F.round("between", 7).alias("between"), F.round("se", 7).alias("se"), F.round("df", 5).alias("df"))


@query("m_part", """
WITH c AS (SELECT g AS feature, d / 4.0::DOUBLE AS delta_std, avg(x2 - 230) + d / 4.0::DOUBLE * 10 AS coef FROM {v}, range(-12, 13) t(d) GROUP BY 1, d), z AS (SELECT feature, coef AS c FROM c WHERE delta_std = 0),
t AS (SELECT c.feature, min(abs(delta_std)) FILTER (sign(coef) <> sign(z.c)) AS delta FROM c JOIN z ON c.feature = z.feature GROUP BY 1)
SELECT feature, delta, CASE WHEN delta IS NULL OR delta >= 1 THEN 'ROBUST' WHEN delta >= 0.5 THEN 'MILD' ELSE 'SENSITIVE' END AS verdict FROM t""")
def tipping_point(df):
    c = df.groupBy(F.col("g").alias("feature")).agg(F.avg(F.col("x2") - 230).alias("b")).withColumn("delta_std", F.explode(F.transform(F.sequence(F.lit(-12), F.lit(12)), lambda d: d / F.lit(4.0))))
    return workflow.tipping_point(c.withColumn("coef", F.col("b") + F.col("delta_std") * 10))


def _value(x):
    """A model with an interaction and its expected values for missing features."""
    a, b, c = (F.coalesce(x[n], F.lit(m)) for n, m in (("x1", 25.0), ("x2", 230.0), ("y", 1450.0)))
    return a * 2 + b * 0.5 - c * 0.01 + a * b * 0.001


def _value_sql(*on: bool) -> str:
    a, b, c = (f"coalesce({n}, {m})" if o else m for o, n, m in zip(on, ("x1", "x2", "y"), ("25.0::DOUBLE", "230.0::DOUBLE", "1450.0::DOUBLE"), strict=True))
    return f"({a} * 2 + {b} * 0.5::DOUBLE - {c} * 0.01::DOUBLE + {a} * {b} * 0.001::DOUBLE)"


def _phi_sql(j: int) -> str:
    terms = []
    for s in range(8):
        if not s >> j & 1:
            n = bin(s).count("1")
            w = math.factorial(n) * math.factorial(2 - n) / 6
            terms.append(f"{w!r} * ({_value_sql(*[bool((s | 1 << j) >> i & 1) for i in range(3)])} - {_value_sql(*[bool(s >> i & 1) for i in range(3)])})")
    return " + ".join(terms)


@query("m_part", "SELECT k, " + ", ".join(f"round(CASE WHEN {f} IS NULL THEN 0 ELSE {_phi_sql(j)} END, 8) + 0 AS phi_{f}" for j, f in enumerate(("x1", "x2", "y"))) + " FROM {v}")
def shapley_exact_p3(df):
    t = workflow.exact_shapley(df, ["x1", "x2", "y"], _value, ("k",))
    return t.select("k", *[(F.round(f"phi_{f}", 8) + 0).alias(f"phi_{f}") for f in ("x1", "x2", "y")])


@query("m_lineitem")
def linear_fit(df):
    return linear.fit(df, ["x1", "x2", "x3"], "y_lin").coefficients(df.sparkSession)


@query("m_lineitem")
def ridge_fit(df):
    return linear.fit(df, ["x1", "x2", "x3"], "y_lin", l2=1.0).coefficients(df.sparkSession)


@query("m_lineitem")
def lasso_fit(df):
    return linear.fit(df, ["x1", "x2", "x3"], "y_lin", l1=500.0, compute_se=False).coefficients(df.sparkSession)


@query("m_part")
def cv_ridge(df):
    return linear.cv_ridge(df, "k", ["x1", "x2"], "y", [0.01, 1.0, 100.0])


@query("m_lineitem")
def logistic_fit(df):
    from lacuna.operators import logistic

    m = logistic.fit(df, ["x1", "x3"], "y_bin")
    return m.transform(df).groupBy("g").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg((F.col("prediction") == F.col("y_bin")).cast("double")).alias("accuracy"))


@query("m_part")
def impute_pool(df):
    done = linear.multiple_imputation(df, ["x1", "x2", "y"], "k", 5)
    e = done.groupBy("imputation").agg(F.avg("y").alias("coef"), (F.var_samp("y") / F.count("*")).alias("var")).withColumn("feature", F.lit("mean_y"))
    return results.rubin(e)


def _raw(name, f, sql):
    from lacuna.catalog.diagnose import ORACLES, QUERIES

    QUERIES[name], ORACLES[name] = f, sql


_raw("rbf_gram", _rbf_gram, f"SELECT a.k AS a, b.k AS b, round(CASE WHEN a.k = b.k THEN 1 ELSE exp(-0.1 * (pow(a.f0 - b.f0, 2) + pow(a.f1 - b.f1, 2) + a.s + b.s)) END, 6) AS k FROM {SUPPLIER} a, {SUPPLIER} b")
_raw("gp_kernel", _gp_kernel, f"SELECT a.k AS a, b.k AS b, round(exp(-0.5 * pow(a.f1 - b.f1, 2)), 6) AS rbf, round((1 + sqrt(5) * abs(a.f1 - b.f1) + 5 * pow(a.f1 - b.f1, 2) / 3) * exp(-sqrt(5) * abs(a.f1 - b.f1)), 6) AS matern52, round(exp(-abs(a.f1 - b.f1)), 6) AS matern12 FROM {SUPPLIER} a, {SUPPLIER} b")


@query("m_orders")
def mixed_fit(df):
    from lacuna.operators import mixed

    m = mixed.fit(df, ["x1"], "y_grp", "g")
    rows = [("intercept", m.fixed.intercept), ("x1", float(m.fixed.coef[0])), ("tau2", m.tau2), ("sigma2", m.sigma2), ("icc", m.icc)]
    return df.sparkSession.createDataFrame([(a, float(b)) for a, b in rows], "term string, value double")


@query("m_part")
def sensitivity_curve(df):
    from lacuna.operators import ensemble

    return ensemble.delta_sweep(df, ["x1", "x2"], "y", "k")


@query("m_part")
def ensemble_linear(df):
    from lacuna.operators import ensemble

    models = ensemble.bagged(df, "k", lambda d: linear.fit(d, ["x1", "x2"], "y", l2=1.0, compute_se=False), 5)
    return ensemble.predict_members(models, df, "k")


@query("m_part")
def cv_linear(df):
    return resampling.cross_validate(df, "k", 3, lambda d: linear.fit(d, ["x1", "x2"], "y", l2=1.0, compute_se=False), "y")


@query("m_customer")
def lasso_classifier_fit(df):
    from lacuna.operators import logistic

    df = df.withColumn("b", (F.col("y") > 4000).cast("int"))
    m = logistic.fit(df, ["x1"], "b", l2=0.0, l1=1.0, compute_se=False)
    return m.transform(df).select("k", "probability")


def _stream_moments(spark, sf_dir):
    """Exact moments of daily windows, as a stream holds them, over the events."""
    from lacuna.streaming.pattern_stream import moments_of, windowed_moments

    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.when(F.col("event_id") % 12 >= 1, F.col("value").cast("double")).alias("y"), F.when(F.col("event_id") % 10 >= 1, F.col("user_id").cast("double")).alias("u"))
    ends = {"y": (0.0, 997.0), "u": (0.0, 1303.0)}
    rows = []
    for start, p in moments_of(windowed_moments(t, ["y", "u"], ends), ["y", "u"], ends).items():
        for m, b in p.blocks.items():
            rows.append((start, m, b.n, *(round(float(v), 5) + 0.0 for v in ((b.s[0], b.q[0, -1]) if len(b.obs) else (0.0, 0.0)))))
    return spark.createDataFrame(rows, "start timestamp, pattern string, n double, s double, q double")


_raw("stream_moments", _stream_moments, """
WITH e AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, CASE WHEN event_id % 12 >= 1 THEN (CAST(value AS DOUBLE) - 498.5::DOUBLE) / 498.5::DOUBLE END AS y, CASE WHEN event_id % 10 >= 1 THEN (CAST(user_id AS DOUBLE) - 651.5::DOUBLE) / 651.5::DOUBLE END AS u FROM events)
SELECT start, concat(CASE WHEN y IS NULL THEN '1' ELSE '0' END, CASE WHEN u IS NULL THEN '1' ELSE '0' END) AS pattern, CAST(count(*) AS DOUBLE) AS n,
  round(CASE WHEN count(y) > 0 THEN sum(y) WHEN count(u) > 0 THEN sum(u) ELSE 0 END, 5) AS s,
  round(CASE WHEN count(y) > 0 AND count(u) > 0 THEN sum(y * u) WHEN count(y) > 0 THEN sum(y * y) WHEN count(u) > 0 THEN sum(u * u) ELSE 0 END, 5) AS q
FROM e GROUP BY 1, 2""")


def _nation_kernel(task):
    def run(spark, sf_dir):
        from lacuna.operators import kernels, process

        t = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_regionkey").cast("double").alias("x1"), F.when(F.col("n_nationkey") % 6 > 0, F.col("n_nationkey").cast("double")).alias("x2"), (F.col("n_nationkey") * 2.0 + F.col("n_regionkey")).alias("y"))
        t = t.withColumn("b", (F.col("y") > 25).cast("int"))
        m = process.fit(t, ["x1", "x2"], "y") if task == "process" else kernels.fit_support(t, ["x1", "x2"], "b" if task == "classifier" else "y", task)
        return m.transform(t).select("n_nationkey", "prediction")

    return run


def _event_windows(spark, sf_dir):
    from lacuna.streaming.pattern_stream import windowed_patterns

    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.when(F.col("event_id") % 12 >= 1, F.col("value")).alias("y"), F.when(F.col("event_id") % 10 >= 1, F.col("user_id")).alias("x2"))
    return windowed_patterns(t, ["y", "x2"])


for _task in ("process", "classifier", "regressor"):
    _raw({"process": "gp_fit", "classifier": "svc_fit", "regressor": "svr_fit"}[_task], _nation_kernel(_task), "")
_raw("event_pattern_windows", _event_windows, "SELECT time_bucket(INTERVAL '1 day', ts) AS start, concat(CASE WHEN event_id % 12 >= 1 THEN '0' ELSE '1' END, CASE WHEN event_id % 10 >= 1 THEN '0' ELSE '1' END) AS pattern, count(*) AS n FROM events GROUP BY 1, 2")
