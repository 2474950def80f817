"""Queries on fitted models whose results have a closed form, and scores at given parameters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lacuna.catalog.diagnose import ORACLES, QUERIES, query
from lacuna.functions import checks
from lacuna.functions.numerics import MIDDLE, TAIL, gauss_hermite
from lacuna.operators import advise, arms, auto, bayes, copula, ensemble, explain, glmm, kernels, linear, logistic, resampling, sensitivity
from lacuna.operators.auto import Estimator
from lacuna.plans import gaussian
from lacuna.plans.patterns import collect, collect_weighted

# Joint moments of (x1, x2, z) where x1 alone has gaps: those of (x2, z), and the regression of x1 on both.
MONOTONE = """
WITH a AS (SELECT avg(x2) AS m2, avg(y_lin) AS mz, var_pop(x2) AS v22, covar_pop(x2, y_lin) AS v2z, var_pop(y_lin) AS vzz FROM {v}),
o AS (SELECT avg(x1) AS n1, avg(x2) AS n2, avg(y_lin) AS nz, var_pop(x1) AS s11, var_pop(x2) AS s22, var_pop(y_lin) AS szz, covar_pop(x1, x2) AS s12, covar_pop(x1, y_lin) AS s1z, covar_pop(x2, y_lin) AS s2z FROM {v} WHERE x1 IS NOT NULL),
g AS (SELECT *, (s12 * szz - s1z * s2z) / (s22 * szz - s2z * s2z) AS g2, (s1z * s22 - s12 * s2z) / (s22 * szz - s2z * s2z) AS gz FROM o),
j AS (SELECT m2, mz, v22, v2z, vzz, n1 + g2 * (m2 - n2) + gz * (mz - nz) AS m1, s11 - g2 * s12 - gz * s1z + g2 * g2 * v22 + 2 * g2 * gz * v2z + gz * gz * vzz AS v11, g2 * v22 + gz * v2z AS v12, g2 * v2z + gz * vzz AS v1z FROM a, g),
b AS (SELECT *, (v1z * v22 - v2z * v12) / (v11 * v22 - v12 * v12) AS b1, (v2z * v11 - v1z * v12) / (v11 * v22 - v12 * v12) AS b2 FROM j),
c AS (SELECT *, mz - b1 * m1 - b2 * m2 AS b0, vzz - b1 * v1z - b2 * v2z AS sigma2 FROM b)
"""


def _monotone(df):
    return Estimator("linear", compute_se=False).fit(df, ["x1", "x2"], "y_lin")


@query("m_mono", MONOTONE + "SELECT round(b0, 2) AS intercept, round(b1, 4) AS b1, round(b2, 2) AS b2, round(sigma2, 3) AS sigma2 FROM c")
def linear_fit_with_gaps(df):
    """The main estimator on a feature with missing cells."""
    m = _monotone(df).models[0]
    return df.sparkSession.createDataFrame([(round(float(m.intercept), 2), round(float(m.coef[0]), 4), round(float(m.coef[1]), 2), round(float(m.sigma2), 3))], "intercept double, b1 double, b2 double, sigma2 double")


KNOWN1, KNOWN2 = "(m1 + v12 / v22 * (x2 - m2))", "(m2 + v12 / v11 * (x1 - m1))"
VALUES = f"v AS (SELECT k, x1, x2, b0 + b1 * m1 + b2 * m2 AS f0, b0 + b1 * x1 + b2 * {KNOWN2} AS f1, b0 + b1 * {KNOWN1} + b2 * x2 AS f2, b0 + b1 * x1 + b2 * x2 AS f12 FROM {{v}}, c)"


@query("m_mono", MONOTONE + ", " + VALUES + """
SELECT k, 'x1' AS feature, round(CASE WHEN x1 IS NULL THEN 0 ELSE ((f1 - f0) + (f12 - f2)) / 2 END, 1) AS phi FROM v
UNION ALL SELECT k, 'x2', round(CASE WHEN x1 IS NULL THEN f2 - f0 ELSE ((f2 - f0) + (f12 - f1)) / 2 END, 1) FROM v""")
def shapley_fitted(df):
    """Exact Shapley values of that model; a row without x1 has all of its deviation from x2."""
    return explain.exact(_monotone(df), df, "k", ["x1", "x2"]).select("k", "feature", (F.round("phi", 1) + 0).alias("phi"))


FOUR = ["a", "b", "c", "d"]
FOUR_SQL = "SELECT k, x2 AS a, CAST(k % 7 AS DOUBLE) AS b, CAST(k * k % 11 AS DOUBLE) AS c, CAST(k * 3 % 17 AS DOUBLE) + CAST(0.1 AS DOUBLE) * x2 AS d, y FROM {v} WHERE y IS NOT NULL"


def _minor(columns: tuple[str, ...], rows: tuple[str, ...], put: str | None = None) -> str:
    """The determinant of covariances s_xy as text; with ``put`` that column holds the covariances with y."""
    if not rows:
        return "1.0"
    cell = lambda r, c: f"s_{r}y" if c == put else f"s_{min(r, c)}{max(r, c)}"
    terms = [f"{'-' if i % 2 else '+'} {cell(rows[0], c)} * ({_minor(columns[:i] + columns[i + 1 :], rows[1:], put)})" for i, c in enumerate(columns)]
    return " ".join(terms).removeprefix("+ ")


def _four_sql() -> str:
    """Value of a coalition: the regression of y on its members; Shapley values are the weighted differences."""
    subsets = [tuple(c for j, c in enumerate(FOUR) if m >> j & 1) for m in range(16)]
    pairs = [f"covar_pop({x}, {y}) AS s_{x}{y}" for i, x in enumerate(FOUR) for y in FOUR[i:]] + [f"covar_pop({x}, y) AS s_{x}y" for x in FOUR]
    slopes = [f"({_minor(s, s, x)}) / ({_minor(s, s)}) AS w_{''.join(s)}_{x}" for s in subsets for x in s]
    values = [" + ".join(["0.0"] + [f"w_{''.join(s)}_{x} * ({x} - m_{x})" for x in s]) + f" AS v{m}" for m, s in enumerate(subsets)]
    parts = []
    for j, x in enumerate(FOUR):
        terms = [f"{math.factorial(n := m.bit_count()) * math.factorial(3 - n) / 24!r}::DOUBLE * (v{m | 1 << j} - v{m})" for m in range(16) if not m >> j & 1]
        parts.append(f"SELECT k, '{x}' AS feature, round({' + '.join(terms)}, 3) AS phi FROM v")
    return f"WITH t AS ({FOUR_SQL}), m AS (SELECT {', '.join(f'avg({x}) AS m_{x}' for x in FOUR)}, {', '.join(pairs)} FROM t), w AS (SELECT m.*, {', '.join(slopes)} FROM m), v AS (SELECT k, {', '.join(values)} FROM t, w) " + " UNION ALL ".join(parts)


@query("m_part", _four_sql())
def shapley_four(df):
    """Exact Shapley values over the lattice of four features."""
    t = df.selectExpr(*[f"{e} AS {n}" for n, e in (("k", "k"), ("a", "x2"), ("b", "CAST(k % 7 AS DOUBLE)"), ("c", "CAST(k * k % 11 AS DOUBLE)"), ("d", "CAST(k * 3 % 17 AS DOUBLE) + CAST(0.1 AS DOUBLE) * x2"), ("y", "y"))]).filter("y IS NOT NULL")
    return explain.exact(linear.fit(t, FOUR, "y", compute_se=False), t, "k", FOUR).select("k", "feature", (F.round("phi", 3) + 0).alias("phi"))


WIDE = 60


def _wide(j: int) -> str:
    """Column j of a wide table: one of the features, bent by j, with gaps of its own."""
    return f"CASE WHEN (k + {j}) % 6 >= 1 THEN x{j % 3 + 1} * {1 + j % 4} + (k * {j + 2}) % 11 END"


@query("m_lineitem", "WITH t AS (SELECT " + ", ".join(f"{_wide(j)} AS c{j}" for j in range(WIDE)) + " FROM {v}) " + " UNION ALL ".join(
    f"SELECT {j} AS j, count(c{j}) AS n, round(avg(c{j}), 4) AS mean, round(stddev_samp(c{j}), 4) AS sd, count(*) FILTER (c{j} IS NOT NULL AND c{(j + 7) % WIDE} IS NOT NULL) AS n_both, "
    f"round(sum((c{j} - (SELECT avg(c{j}) FROM t)) * (c{(j + 7) % WIDE} - (SELECT avg(c{(j + 7) % WIDE}) FROM t))) / (SELECT stddev_samp(c{j}) * stddev_samp(c{(j + 7) % WIDE}) FROM t), 3) AS cross FROM t" for j in range(WIDE)))
def wide_moments(df):
    """Sums of squares and of products of 60 columns by pattern, from one aggregation of packed arrays."""
    names = [f"c{j}" for j in range(WIDE)]
    p = collect(df.selectExpr(*[f"{_wide(j)} AS c{j}" for j in range(WIDE)]), names)
    q, n, _ = gaussian.pairwise(list(p.blocks.values()), WIDE)
    rows = [(j, int(n[j, j]), round(float(p.center[j]), 4), round(float(p.scale[j]), 4), int(n[j, (j + 7) % WIDE]), round(float(q[j, (j + 7) % WIDE]), 3)) for j in range(WIDE)]
    return df.sparkSession.createDataFrame(rows, "j int, n long, mean double, sd double, n_both long, cross double")


@query("m_mono", MONOTONE + ", w AS (SELECT k, coalesce(x1, n1 + s12 / s22 * (x2 - n2)) AS x1, x2, m1, m2, v11, v12, v22, b0, b1, b2 FROM {v}, c, o)" + f"""
SELECT k, 'x1' AS feature, round(b1 * (x1 - {KNOWN1}), 0) AS phi FROM w
UNION ALL SELECT v.k, 'x2', round(CASE WHEN v.x1 IS NULL THEN w.b0 + w.b1 * (w.m1 + w.v12 / w.v22 * (w.x2 - w.m2)) + w.b2 * w.x2 - (w.b0 + w.b1 * w.m1 + w.b2 * w.m2) ELSE w.b2 * (w.x2 - (w.m2 + w.v12 / w.v11 * (w.x1 - w.m1))) END, 0) FROM w JOIN {{v}} v ON v.k = w.k""")
def miss_shap_fitted(df):
    """What observing each feature is worth to that model."""
    e = explain.fit(_monotone(df), df, ["x1", "x2"])
    return e.missing(df, "k").select("k", "feature", (F.round("phi", 0) + 0).alias("phi"))


@query("m_part", """
WITH s AS (SELECT avg(y) AS my, var_samp(y) AS vy, avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS v1, var_samp(x2) AS v2, covar_samp(x1, y) AS c1, covar_samp(x2, y) AS c2, covar_samp(x1, x2) AS c12,
  avg(y) FILTER (x1 IS NOT NULL) AS y1, var_samp(y) FILTER (x1 IS NOT NULL) AS w1, count(x1) AS n1 FROM {v} WHERE y IS NOT NULL),
r AS (SELECT my, vy, c1 / w1 AS b1, c2 / vy AS b2, m1 - c1 / w1 * y1 AS a1, m2 - c2 / vy * my AS a2, (v1 - c1 * c1 / w1) * (1 + 1e-9) AS t1, (v2 - c2 * c2 / vy) * (1 + 1e-9) AS t2,
  c12 - c1 / w1 * c2 / vy * vy AS raw, least(0.9, greatest(0.05, 2.0 / (2 + n1))) AS lam FROM s),
t AS (SELECT *, raw * (1 - lam) AS t12 FROM r), d AS (SELECT *, t1 * t2 - t12 * t12 AS det FROM t),
w AS (SELECT v.k, v.x1, v.x2, d.*, CASE WHEN x1 IS NULL THEN 0 ELSE (b1 * t2 - b2 * t12) / det END AS w1, CASE WHEN x1 IS NULL THEN b2 / t2 ELSE (b2 * t1 - b1 * t12) / det END AS w2 FROM {v} v, d)
SELECT k, round((my / vy + coalesce(w1 * (x1 - a1), 0) + w2 * (x2 - a2)) / (1 / vy + b1 * w1 + b2 * w2), 2) AS prediction, round(1 / sqrt(1 / vy + b1 * w1 + b2 * w2), 3) AS sd FROM w""")
def bayes_reg_full_p2(df):
    m = bayes.fit_regressor(df, ["x1", "x2"], "y", "full")
    return m.transform(df).select("k", F.round("prediction", 2).alias("prediction"), F.round("sd", 3).alias("sd"))


# The noise of a ridge fit with one complete feature solves s = rss(b(s)) / n, b(s) = sxy / (sxx + alpha s), on standardised columns.
@query("m_part", """
WITH RECURSIVE p AS (SELECT avg(x2) AS mx, stddev_samp(x2) AS dx, avg(y) AS my, stddev_samp(y) AS dy FROM {v}),
s AS (SELECT count(*) AS n, avg((x2 - mx) / dx) AS ax, avg((y - my) / dy) AS ay, var_pop((x2 - mx) / dx) * count(*) AS sxx, var_pop((y - my) / dy) * count(*) AS syy, covar_pop((x2 - mx) / dx, (y - my) / dy) * count(*) AS sxy FROM {v}, p WHERE y IS NOT NULL),
i(t, v) AS (SELECT 0, syy / n FROM s UNION ALL SELECT t + 1, (syy - 2 * sxy / (sxx + 25 * v) * sxy + pow(sxy / (sxx + 25 * v), 2) * sxx) / n FROM i, s WHERE t < 60),
b AS (SELECT sxy / (sxx + 25 * v) AS b, v, ax, ay FROM i, s WHERE t = 60)
SELECT round(b * dy / dx, 5) AS slope, round(my + dy * (ay - b * ax) - b * dy / dx * mx, 2) AS intercept, round(v * dy * dy, 1) AS sigma2 FROM b, p""")
def ridge_complete(df):
    m = Estimator("ridge", alpha=25.0, compute_se=False).fit(df, ["x2"], "y").models[0]
    return df.sparkSession.createDataFrame([(round(float(m.coef[0]), 5), round(float(m.intercept), 2), round(float(m.sigma2), 1))], "slope double, intercept double, sigma2 double")


def _at(df, columns, center, scale):
    """Pattern blocks on a given scale."""
    return collect(df, columns, at=(center, scale))


@query("m_part", """
WITH z AS (SELECT (x1 - 25) / 14 AS u1, (x2 - 130) / 15 AS u2, (y - 1000) / 60 AS t FROM {v} WHERE y IS NOT NULL),
f AS (SELECT t, u2 AS f2, coalesce(u1, 0.4::DOUBLE * u2) AS f1, CASE WHEN u1 IS NULL THEN 1 - 0.16::DOUBLE ELSE 0 END AS c FROM z),
r AS (SELECT *, t - (0.1 + 0.3 * f1 + 0.5 * f2) AS r, 0.64::DOUBLE + 0.09 * c AS s FROM f)
SELECT round(sum(0.5 * (ln(2 * pi()) + ln(s)) + 0.5 * r * r / s) + 0.5 * 2 * (0.09 + 0.25), 3) AS nll, round(-sum(r / s), 3) AS g0,
  round(-sum(r * f1 / s) + sum((1 / s - r * r / (s * s)) * c * 0.3) + 2 * 0.3, 3) AS g1, round(-sum(r * f2 / s) + 2 * 0.5, 3) AS g2, round(sum((1 / s - r * r / (s * s)) * 0.64), 3) AS g_sigma FROM r""")
def linear_score_at_theta(df):
    """The likelihood of linear, ridge and lasso fits and its gradient at given parameters, with a feature that has gaps."""
    p = _at(df, ["x1", "x2", "y"], (25.0, 130.0, 1000.0), (14.0, 15.0, 60.0))
    blocks = linear.label_blocks(p, np.zeros(2), np.array([[1.0, 0.4], [0.4, 1.0]]))
    value, grad = linear.objective(blocks, np.array([0.1, 0.3, 0.5, math.log(0.8)]), 2.0)
    return df.sparkSession.createDataFrame([tuple(round(float(x), 3) for x in (value, *grad))], "nll double, g0 double, g1 double, g2 double, g_sigma double")


def _nodes(n, a, v):
    t, w = gauss_hermite(n)
    return " + ".join(f"{wk!r}::DOUBLE / (1 + exp(-({a} + sqrt({v}) * {tk!r}::DOUBLE)))" for tk, wk in zip(t.tolist(), w.tolist(), strict=True))


def _slopes(n, s, v, power):
    """Sum over the nodes of weight times slope of the sigmoid, and times the node if ``power``."""
    t, w = gauss_hermite(n)
    return " + ".join(f"{wk * (tk if power else 1)!r}::DOUBLE * exp(-({s} + sqrt({v}) * {tk!r}::DOUBLE)) / pow(1 + exp(-({s} + sqrt({v}) * {tk!r}::DOUBLE)), 2)" for tk, wk in zip(t.tolist(), w.tolist(), strict=True))


THETAS = ((0.1, 0.8), (-0.4, 0.3), (0.6, -0.9))


@query("m_customer", " UNION ALL ".join(f"""
SELECT {i} AS theta, round(-sum(ln(p)) + 0.5 * 0.01 * {t1} * {t1}, 3) AS nll, round(-sum(sg * pa / p), 3) AS g0, round(-sum(sg * pa * f / p) - sum(CASE WHEN v > 0 THEN sg2 * pt / (2 * sqrt(v)) / p * 2 * 0.9 * {t1} ELSE 0 END) + 0.01 * {t1}, 3) AS g1
FROM (SELECT f, v, sg, 1 AS sg2, CASE WHEN v = 0 THEN 1 / (1 + exp(-s)) ELSE {_nodes(20, "s", "v")} END AS p, CASE WHEN v = 0 THEN exp(-s) / pow(1 + exp(-s), 2) ELSE {_slopes(20, "s", "v", 0)} END AS pa, CASE WHEN v = 0 THEN 0 ELSE {_slopes(20, "s", "v", 1)} END AS pt
  FROM (SELECT 2 * b - 1 AS sg, coalesce(u, 0.2::DOUBLE) AS f, CASE WHEN u IS NULL THEN {t1 * t1} * 0.9::DOUBLE ELSE 0 END AS v, (2 * b - 1) * ({t0} + {t1} * coalesce(u, 0.2::DOUBLE)) AS s
    FROM (SELECT (x1 - 12) / 7 AS u, CASE WHEN y > 4000 THEN 1 ELSE 0 END AS b FROM {{v}} WHERE y IS NOT NULL)))""" for i, (t0, t1) in enumerate(THETAS)))
def logistic_score_at_theta(df):
    """The likelihood that logistic fits maximise, and its gradient, at several given parameters from one pass."""
    rows = df.withColumn("b", F.when(F.col("y") > 4000, 1.0).when(F.col("y").isNotNull(), 0.0))
    packed = logistic.blocks(rows, ["x1"], "b", np.array([12.0]), np.array([7.0]))
    seen = df.sparkSession.sparkContext.broadcast([logistic.views(np.array([0.2]), np.array([[0.9]]), ["0", "1"])] * len(THETAS))
    values, grads, _ = logistic.score_many(packed, seen, np.array(THETAS))
    out = [(i, round(float(-v + 0.005 * t[1] ** 2), 3), round(float(-g[0]), 3), round(float(-g[1] + 0.01 * t[1]), 3)) for i, (v, g, t) in enumerate(zip(values, grads, THETAS, strict=True))]
    return df.sparkSession.createDataFrame(out, "theta int, nll double, g0 double, g1 double")


def _newton_sql(steps):
    """Newton's method for a logistic regression on one standardised complete column, with a ridge of 0.01 on its coefficient."""
    parts = ["z AS (SELECT y_bin AS y, (x - (SELECT avg(x) FROM c)) / (SELECT stddev_samp(x) FROM c) AS x FROM c WHERE y_bin IS NOT NULL), b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(steps):
        parts.append(f"""s{i} AS (SELECT a, b, sum(y - p) AS g0, sum((y - p) * x) - 0.01 * b AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 0.01 AS h11
  FROM (SELECT a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM z, b{i}) GROUP BY a, b),
b{i + 1} AS MATERIALIZED (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{i})""")
    return ", ".join(parts)


@query("m_lineitem", f"WITH c AS (SELECT y * 100 + k % 3 AS x, y_bin FROM {{v}}), {_newton_sql(9)} SELECT round(a - b * (SELECT avg(x) / stddev_samp(x) FROM c), 4) AS intercept, round(b / (SELECT stddev_samp(x) FROM c), 5) AS slope FROM b9")
def logistic_newton(df):
    """A logistic fit on a complete column, to convergence."""
    m = logistic.fit(df.withColumn("x", F.col("y") * 100 + F.col("k") % 3), ["x"], "y_bin", compute_se=False)
    return df.sparkSession.createDataFrame([(round(float(m.intercept), 4), round(float(m.coef[0]), 5))], "intercept double, slope double")


@query("m_lineitem")
def cv_logistic(df):
    """Five folds and three penalties of a logistic fit with gaps, from the jobs of one fit."""
    return logistic.cross_validate(df, "k", ["x1", "x3"], "y_bin", [(0.01, 0.0), (10.0, 0.0), (0.0, 20.0)])


def _node_sql(count, eta):
    t, logw = glmm.nodes(count)
    return " UNION ALL ".join(f"SELECT g, {float(x)!r}::DOUBLE AS t, {float(w)!r}::DOUBLE AS lw, sum(-ln(1 + exp(-(2 * b - 1) * ({eta} + 0.3 + sqrt(2) * 0.9 * {float(x)!r}::DOUBLE)))) AS l FROM z GROUP BY g" for x, w in zip(t, logw, strict=True))


@query("m_customer", f"""
WITH z AS (SELECT g, CASE WHEN y > 4000 THEN 1 ELSE 0 END AS b, 1 / sqrt(1 + CASE WHEN x1 IS NULL THEN pi() / 8 * 0.64 * 0.9 ELSE 0 END) AS s, 0.1 + 0.8 * coalesce((x1 - 12) / 7, 0.2::DOUBLE) AS e FROM {{v}} WHERE y IS NOT NULL),
n AS ({_node_sql(7, "e").replace("(e + 0.3 + sqrt(2) * 0.9 * ", "s * (e + 0.3 + sqrt(2) * 0.9 * ")}),
h AS (SELECT g, l + lw + ln(sqrt(2) * 0.9) - 0.5 * ln(2 * pi() * 0.49) - pow(0.3 + sqrt(2) * 0.9 * t, 2) / 0.98 AS h, 0.3 + sqrt(2) * 0.9 * t AS b FROM n), m AS (SELECT g, max(h) AS m FROM h GROUP BY g)
SELECT h.g, round(m + ln(sum(exp(h - m))), 4) AS loglik, round(sum(b * exp(h - m)) / sum(exp(h - m)), 5) AS blup FROM h JOIN m ON h.g = m.g GROUP BY h.g, m""")
def glmm_score_at_theta(df):
    """Each group's integrated likelihood and expected intercept in the mixed classifier, at given parameters and node places."""
    rows = df.filter("y IS NOT NULL").select(
        F.col("g").alias("_g"), F.when(F.col("y") > 4000, 1.0).otherwise(0.0).alias("_y"), F.when(F.col("x1").isNull(), "1").otherwise("0").alias("_m"),
        F.coalesce((F.col("x1") - 12) / 7, F.lit(0.2)).alias("f0"), F.lit(0.3).alias("_b"), F.lit(0.9).alias("_sd"),
    )
    t = glmm.score(rows, 1, {"0": np.zeros((1, 1)), "1": np.array([[0.9]])}, np.array([0.1, 0.8, math.log(0.7)]), 7)
    return t.select(F.col("_g").alias("g"), F.round("loglik", 4).alias("loglik"), F.round("blup", 5).alias("blup"))


@query("m_orders", """
WITH z AS (SELECT g, x1, y_grp - 2 - 0.001::DOUBLE * x1 AS r FROM {v} WHERE x1 IS NOT NULL), s AS (SELECT g, count(*) AS n, sum(r) AS r, sum(r * r) AS q, sum(x1) AS sx, sum(r * x1) AS rx FROM z GROUP BY g)
SELECT round(sum(-0.5 * (n * ln(2 * pi() * 1.5) + ln(1 + n * 4 / 1.5) + q / 1.5 - 4 * pow(r / 1.5, 2) / (1 + 4 * n / 1.5))), 2) AS loglik,
  round(sum(r / 1.5 / (1 + 4 * n / 1.5)), 3) AS g0, round(sum(rx / 1.5 - 4 * r / 1.5 * sx / 1.5 / (1 + 4 * n / 1.5)), 0) AS g1,
  round(sum(-1.5 * (n / 1.5 - n * 4 / 2.25 / (1 + n * 4 / 1.5) - q / 2.25 + 4 * r * r * (3 + 4 * n) / pow(2.25 + 6 * n, 2))), 2) AS g_sigma,
  round(sum(-4 * (n / 1.5 / (1 + n * 4 / 1.5) - pow(r / 1.5 / (1 + 4 * n / 1.5), 2))), 2) AS g_tau FROM s""")
def mixed_loglik_at_theta(df):
    """The random-intercept likelihood and its gradient at given variances and coefficients, by the blocks that fits use."""
    from lacuna.operators import mixed

    theta = np.array([2.0, 0.001, 0.5 * math.log(1.5), math.log(2.0)])
    subjects = mixed.Subjects(df.filter("x1 IS NOT NULL"), ["x1"], "y_grp", "g", np.zeros(1), np.eye(1), ["00"], (np.zeros(2), np.ones(2)))
    values, grads = subjects.score(theta[None])
    row = [float(values[0]), *map(float, grads[0])]
    return df.sparkSession.createDataFrame([tuple(round(v, d) for v, d in zip(row, (2, 3, 0, 2, 2), strict=True))], "loglik double, g0 double, g1 double, g_sigma double, g_tau double")


@query("m_part", " UNION ALL ".join(f"""
SELECT {i} AS member, concat(CASE WHEN x1 IS NULL THEN '1' ELSE '0' END, '0', CASE WHEN y IS NULL THEN '1' ELSE '0' END) AS pattern, CAST(sum({w}) AS DOUBLE) AS n, round(sum({w} * (x2 - 130) / 15), 4) AS s, round(sum({w} * (x2 - 130) / 15 * (x1 - 25) / 14), 4) AS q
FROM {{v}} GROUP BY 2 HAVING sum({w}) > 0""" for i, w in enumerate(("k % 3", "(k + 1) % 4", "CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END"))))
def weighted_moments(df):
    """Block sums under several sets of row weights, as bootstraps have them, from one scan."""
    rows, weights = [], [F.col("k") % 3, (F.col("k") + 1) % 4, F.when(F.col("k") % 7 == 0, 5).otherwise(0)]
    for i, p in enumerate(collect_weighted(df, ["x1", "x2", "y"], weights, at=((25.0, 130.0, 1000.0), (14.0, 15.0, 60.0)))):
        for m, b in p.blocks.items():
            at = list(b.obs).index(1)
            rows.append((i, m, b.n, round(float(b.s[at]), 4) + 0.0, round(float(b.q[at, 0]), 4) + 0.0 if m[0] == "0" else None))
    return df.sparkSession.createDataFrame(rows, "member int, pattern string, n double, s double, q double")


SUPPORT = "(VALUES (-1.0, 0.5, 0.8), (0.3, NULL, -0.6), (NULL, -0.7, 0.4), (1.2, 1.1, -0.3))"


def _factor(x: str, y: str) -> str:
    one = lambda v: f"sqrt(2.25 / 3.25) * exp(-{v} * {v} / (2 * 3.25))"
    return f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN sqrt(2.25 / 4.25) WHEN {x} IS NULL THEN {one(y)} WHEN {y} IS NULL THEN {one(x)} ELSE exp(-0.5 * pow(({x} - {y}) / 1.5, 2)) END"


@query("m_part", f"""
WITH q AS (SELECT k, (x1 - 25) / 14 AS a, CASE WHEN k % 4 > 0 THEN (x2 - 130) / 15 END AS b FROM {{v}}), s AS (SELECT a::DOUBLE AS c, b::DOUBLE AS d, w::DOUBLE AS w FROM {SUPPORT} t(a, b, w))
SELECT k, round(5 + 2 * sum(w * ({_factor("a", "c")}) * ({_factor("b", "d")})), 6) AS prediction FROM q, s GROUP BY k""")
def kernel_predict(df):
    """Predictions of kernel machines over expected kernels, at given weights; cells are missing on both sides."""
    rows = np.array([[-1.0, 0.5], [0.3, np.nan], [np.nan, -0.7], [1.2, 1.1]])
    m = kernels.KernelModel(["x1", "x2"], np.array([25.0, 130.0]), np.array([14.0, 15.0]), rows, np.array([0.8, -0.6, 0.4, -0.3]), kernels.Shape("rbf", np.full(2, 1.5)), 5.0, 2.0, "regressor")
    t = df.select("k", "x1", F.when(F.col("k") % 4 > 0, F.col("x2")).alias("x2"))
    return m.transform(t).select("k", F.round("prediction", 6).alias("prediction"))




def _poly(c, x):
    out = f"{c[0]!r}::DOUBLE"
    for v in c[1:]:
        out = f"({out}) * {x} + {v!r}::DOUBLE"
    return out


def _quantile_sql(u):
    """The normal quantile, but for probabilities below exp(-25)."""
    ratio = lambda parts, x: f"({_poly(parts[0], x)}) / ({_poly(parts[1], x)})"
    tail = ratio(TAIL, f"(sqrt(-ln(least({u}, 1 - {u}))) - 1.6::DOUBLE)")
    middle = ratio(MIDDLE, f"(0.180625::DOUBLE - pow({u} - 0.5, 2))")
    return f"CASE WHEN abs({u} - 0.5) <= 0.425 THEN {middle} * ({u} - 0.5) ELSE {tail} * sign({u} - 0.5) END"


NORMAL = f"""
WITH r AS (SELECT x1, (row_number() OVER (ORDER BY x1) - 0.375::DOUBLE) / (count(*) OVER () + 0.25::DOUBLE) AS u FROM {{v}} WHERE x1 IS NOT NULL),
s AS (SELECT x1, avg({_quantile_sql("u")}) AS z FROM r GROUP BY x1)"""


@query("m_part", NORMAL + " SELECT v.k, round(s.z, 5) AS z, CASE WHEN v.x1 IS NOT NULL THEN v.x1 END AS back FROM {v} v LEFT JOIN s ON v.x1 = s.x1")
def copula_transform(df):
    """Normal scores of a column with ties and gaps, and the way back."""
    c = copula.fit(df, ["x1"])
    z = c.transform(df)
    return z.select("k", F.round("x1", 5).alias("z"), F.round(c.inverse_column("x1", F.col("x1")), 9).alias("back"))


TIED = "CASE WHEN k % 3 = 0 THEN 20000.5 ELSE x2 END"


@query("m_lineitem", f"""
WITH t AS (SELECT k, {TIED} AS x1 FROM {{v}}), """ + NORMAL.replace("{v}", "t").strip().removeprefix("WITH ") + " SELECT t.k, round(s.z, 5) AS z, round(t.x1, 6) AS back FROM t LEFT JOIN s ON t.x1 = s.x1")
def copula_many(df):
    """Normal scores of a column with more knots than the driver holds and a tie of a third of its rows, and the way back, by range joins."""
    t = df.select("k", F.expr(TIED).cast("double").alias("x"))
    c = copula.fit(t, ["x"])
    z = c.transform(t)
    return c.inverse(z.withColumn("z", F.round("x", 5))).select("k", "z", F.round("x", 6).alias("back"))


@query("m_part", """
WITH e AS (SELECT *, CASE WHEN k % 50 = 0 THEN 'Infinity'::DOUBLE ELSE x1 END AS a, NULL::DOUBLE AS b, y / 3 AS c FROM {v})
SELECT 'a' AS "column", 'infinite values' AS rule FROM e HAVING count(*) FILTER (isinf(a)) > 0
UNION ALL SELECT 'b', 'empty feature' FROM e HAVING count(*) > 0 AND count(b) = 0
UNION ALL SELECT 'c', 'continuous label' FROM e HAVING count(*) FILTER (c <> floor(c)) > 0""")
def validation_rules(df):
    """What a table breaks before any fit: infinite cells, an empty feature, a continuous label for a classifier."""
    t = df.select(F.when(F.col("k") % 50 == 0, float("inf")).otherwise(F.col("x1")).alias("a"), F.lit(None).cast("double").alias("b"), (F.col("y") / 3).alias("c"), "x2")
    return checks.rules(checks.input_profile(t, ["a", "b", "x2"], "c"), "c", classifier=True)


@query("m_customer", """
SELECT 'x1' AS "column", CASE WHEN count(*) FILTER (x1 <> floor(x1)) = 0 AND count(DISTINCT x1) = 2 THEN 'binary' WHEN count(*) FILTER (x1 <> floor(x1)) = 0 AND count(DISTINCT x1) <= 10 THEN 'categorical' ELSE 'numeric' END AS kind FROM {v}
UNION ALL SELECT 'd', CASE WHEN count(DISTINCT x1 % 3) = 2 THEN 'binary' WHEN count(DISTINCT x1 % 3) <= 10 THEN 'categorical' ELSE 'numeric' END FROM {v} UNION ALL SELECT 'g', 'text' UNION ALL SELECT 'e', CASE WHEN count(DISTINCT k % 2) = 2 THEN 'binary' ELSE 'categorical' END FROM {v}""")
def detect_encoding(df):
    return auto.detect_encoding(df.select("x1", "g", (F.col("x1") % 3).alias("d"), (F.col("k") % 2).alias("e")), ["x1", "d", "g", "e"])


@query("m_customer", ORACLES["bayes_clf_naive"])
def auto_bayes_classes(df):
    """The family's dispatcher finds text classes and fits the classifier."""
    m = Estimator("bayes", structure="naive").fit(df, ["x1", "y"], "g")
    return m.transform(df).select("k", "prediction", F.round(F.array_max("probabilities"), 5).alias("confidence"))


@query("m_part", """
WITH m AS (SELECT avg(x1) AS m FROM {v} WHERE y IS NOT NULL AND k % 5 > 0), t AS (SELECT k, coalesce(x1, m) AS a, x2 AS b, y FROM {v}, m WHERE y IS NOT NULL), r AS (SELECT * FROM t WHERE k % 5 > 0),
s AS (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM r),
c AS (SELECT *, (ca * vb - cb * cab) / (va * vb - cab * cab) AS p, (cb * va - ca * cab) / (va * vb - cab * cab) AS q FROM s), e AS (SELECT y, my + p * (a - ma) + q * (b - mb) AS f FROM t, c WHERE k % 5 = 0)
SELECT 'mean' AS arm, round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg(pow(y - f, 2))), 3) AS rmse FROM e
UNION ALL SELECT * FROM (WITH t AS (SELECT k, x1 AS a, x2 AS b, y FROM {v} WHERE y IS NOT NULL AND x1 IS NOT NULL), r AS (SELECT * FROM t WHERE k % 5 > 0),
s AS (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM r),
c AS (SELECT *, (ca * vb - cb * cab) / (va * vb - cab * cab) AS p, (cb * va - ca * cab) / (va * vb - cab * cab) AS q FROM s), e AS (SELECT y, my + p * (a - ma) + q * (b - mb) AS f FROM t, c WHERE k % 5 = 0)
SELECT 'drop_rows', round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 5), round(sqrt(avg(pow(y - f, 2))), 3) FROM e)""")
def benchmark_fold(df):
    """Two arms on one fold, with unpenalised regressions."""
    rows = df.filter("y IS NOT NULL")
    out = []
    for arm in ("mean", "drop_rows"):
        s = arms.evaluate(arm, rows.filter("k % 5 > 0"), rows.filter("k % 5 = 0"), ["x1", "x2"], "y", "k", l2=0.0)
        out.append((arm, round(s["r2"], 5), round(s["rmse"], 3)))
    return df.sparkSession.createDataFrame(out, "arm string, r2 double, rmse double")


STRUCTURE = """
WITH e AS (SELECT count(*) AS n, 2 AS p_all, (count(x1) / count(*) >= 0.4)::INT + (count(x2) / count(*) >= 0.4)::INT AS p, count(*) FILTER (x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL) AS n_complete,
  (count(*) FILTER (x1 IS NULL) + count(*) FILTER (x2 IS NULL)) / (2 * count(*)) AS cell_rate, avg((x1 IS NULL OR x2 IS NULL)::INT) AS row_rate, avg((y IS NULL)::INT) AS y_rate, count(DISTINCT concat(x1 IS NULL, x2 IS NULL)) AS n_patterns,
  abs(kurtosis_pop(x1)) > 7 OR abs(kurtosis_pop(x2)) > 7 AS heavy_tailed, greatest(stddev_samp(x1), stddev_samp(x2)) / least(stddev_samp(x1), stddev_samp(x2)) > 1000 AS scale_imbalance, count(DISTINCT g) AS n_groups FROM {v}),
a AS (SELECT g, count(y) AS c, avg(y) AS m, var_pop(y) * count(y) AS w FROM {v} WHERE y IS NOT NULL GROUP BY g), t AS (SELECT count(*) AS k, sum(c) AS c, sum(w) AS w, sum(c * m * m) - pow(sum(c * m), 2) / sum(c) AS b FROM a),
i AS (SELECT greatest(0, (b / (k - 1) - w / (c - k)) / (c / k)) AS vb, w / (c - k) AS vw FROM t)"""


@query("m_part", STRUCTURE + " SELECT n, p_all, p, n_complete, round(cell_rate, 8) AS cell_rate, round(row_rate, 8) AS row_rate, round(y_rate, 8) AS y_rate, n_patterns, heavy_tailed, scale_imbalance, n_groups, round(vb / (vb + vw), 6) AS icc FROM e, i")
def recommend_evidence(df):
    t = advise.structure(df, ["x1", "x2"], "y", "g")
    return t.withColumns({c: F.round(c, 8) for c in ("cell_rate", "row_rate", "y_rate")}).withColumn("icc", F.round("icc", 6))


@query("m_part", STRUCTURE + """, d AS (SELECT *, vb / (vb + vw) AS icc, p >= n_complete OR p > 0.5 * n AS wide FROM e, i), f(family, place) AS (VALUES ('linear', 1), ('ridge', 2), ('lasso', 3), ('bayes', 4), ('neighbors', 5), ('support', 6), ('process', 7), ('mixed', 8)),
s AS (SELECT family, place, (CASE WHEN family = 'mixed' THEN CASE WHEN icc >= 0.05 THEN 4 ELSE -1 END WHEN place <= 3 AND icc >= 0.05 THEN -1.5 ELSE 0 END
  + CASE WHEN wide THEN CASE WHEN family IN ('ridge', 'lasso') THEN 2.5 WHEN family = 'linear' THEN -2.5 WHEN family = 'bayes' THEN -2 ELSE 0 END WHEN p >= 15 AND family = 'ridge' THEN 1 WHEN p >= 15 AND family = 'lasso' THEN 0.5 ELSE 0 END
  + CASE family WHEN 'linear' THEN 2 WHEN 'ridge' THEN 1.5 WHEN 'lasso' THEN 1 WHEN 'bayes' THEN 1 WHEN 'neighbors' THEN -1.5 WHEN 'support' THEN -1.5 ELSE 0 END
  + CASE WHEN cell_rate >= 0.3 THEN CASE family WHEN 'bayes' THEN 2 WHEN 'neighbors' THEN -1 ELSE 0 END WHEN cell_rate >= 0.1 AND family = 'bayes' THEN 1 ELSE 0 END
  + CASE WHEN heavy_tailed THEN CASE family WHEN 'neighbors' THEN 1 WHEN 'support' THEN 1 WHEN 'bayes' THEN -1 ELSE 0 END ELSE 0 END)::DOUBLE AS points, family = 'process' AND n > 1000 AS vetoed FROM d, f)
SELECT family, points, vetoed, row_number() OVER (ORDER BY vetoed, points DESC, place)::INT AS rank FROM s""")
def recommend_scores(df):
    """Points on evidence from the table; only the probe's outcome is given, as SQL has none (``recommend_model`` probes)."""
    row = advise.structure(df, ["x1", "x2"], "y", "g").withColumns({"task": F.lit("regression"), "ratio": F.lit(0.5), "has_skill": F.lit(True)})
    return advise.scored(row).select("family", "points", "vetoed", "rank")


@query("m_part")
def recommend_model(df):
    """Everything from the table: tests of the mechanism, the linearity probe, ranking and reasons."""
    return advise.recommend(df, ["x1", "x2"], "y", "k", group="g").ranking


@query("m_customer")
def mixed_classifier(df):
    b = df.withColumn("b", (F.col("y") > 4000).cast("int"))
    m = Estimator("mixed", rounds=1, steps=6).fit(b, ["x1"], "b", group="g")
    return m.transform(b).select("k", "prediction", F.round(F.col("probabilities")[1], 6).alias("probability"))


def _process_classifier(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.when(F.col("s_suppkey") % 6 > 0, F.col("s_acctbal")).alias("x1"), F.col("s_nationkey").cast("double").alias("x2"), (F.col("s_acctbal") + 100 * F.col("s_nationkey") > 5000).cast("int").alias("b"))
    return Estimator("process", kernel="matern52", restarts=0, steps=8).fit(t, ["x1", "x2"], "b").transform(t).select("s_suppkey", "prediction", F.round(F.col("probabilities")[1], 6).alias("probability"))


QUERIES["process_classifier"] = _process_classifier


@query("m_part")
def benchmark_arms(df):
    """All arms over folds, with their means and spreads."""
    return arms.table(arms.run_folds(df, ["x1", "x2"], "y", "k", folds=2))


@query("m_part")
def cv_metrics_by_group(df):
    return resampling.cross_validate_metrics(df, "k", 3, lambda d: Estimator("bayes").fit(d, ["x1", "x2"], "y"), "y", ("r2", "neg_mean_absolute_error"), group="g").select("fold", "metric", "test")




# Two given imputations of the outcome, and least squares of it under 25 shifts of the missing ones, pooled.
SWEEP = """
WITH z AS (SELECT i, x1 AS x, coalesce(y, 900 + 20 * i + 9 * (x1 % 7) + k % 5) AS y, CASE WHEN y IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM {v}, range(1, 3) t(i) WHERE x1 IS NOT NULL),
c AS (SELECT i, count(*) AS n, var_pop(x) AS vx, covar_pop(x, y) AS xy, covar_pop(x, r) AS xr, var_pop(y) AS vy, covar_pop(y, r) AS yr, var_pop(r) AS vr FROM z GROUP BY i),
d AS (SELECT d / 4.0::DOUBLE AS delta_std, d / 4.0::DOUBLE * (SELECT stddev_samp(y) FROM {v}) AS s FROM range(-12, 13) t(d)),
f AS (SELECT delta_std, (xy + s * xr) / vx AS b, (vy + 2 * s * yr + s * s * vr - pow(xy + s * xr, 2) / vx) / (vx * (n - 2)) AS v FROM c, d),
w AS (SELECT delta_std, avg(b) AS coef, sqrt(avg(v) + 1.5 * var_samp(b)) AS se FROM f GROUP BY delta_std)
"""


def _swept(df):
    done = df.filter("x1 IS NOT NULL").withColumn("imputation", F.explode(F.array(F.lit(1), F.lit(2))))
    done = done.withColumn("r", F.col("y").isNull().cast("double")).withColumn("y", F.coalesce("y", F.lit(900.0) + 20 * F.col("imputation") + 9 * (F.col("x1") % 7) + F.col("k") % 5))
    sd = df.agg(F.stddev_samp("y")).first()[0]
    return sensitivity.linear_cells(done, ["x1"], "y", "r", np.linspace(-3, 3, 25) * sd).curve(df.sparkSession, sd)


@query("m_part", SWEEP + "SELECT 'x1' AS feature, delta_std, round(coef, 6) AS coef, round(se, 6) AS se FROM w")
def sensitivity_given_imputations(df):
    """Least squares of all shifts and two imputations from one aggregation."""
    return _swept(df).select("feature", "delta_std", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"))


@query("m_part", SWEEP + """, o AS (SELECT coef AS c0, se AS s0 FROM w WHERE delta_std = 0),
t AS (SELECT min(c0) AS coef, min(coef) AS least, max(coef) AS greatest, min(abs(delta_std)) FILTER (sign(coef - 0.02) <> sign(c0 - 0.02)) AS sign_tip,
  min(abs(delta_std)) FILTER ((abs(coef - 0.02) <= 1.959963984540054 * se) <> (abs(c0 - 0.02) <= 1.959963984540054 * s0)) AS interval_tip FROM w, o)
SELECT 'x1' AS feature, round(coef, 6) AS coef, round(least, 6) AS least, round(greatest, 6) AS greatest, sign_tip, interval_tip,
  CASE WHEN sign_tip IS NULL OR sign_tip >= 1 THEN 'ROBUST' WHEN sign_tip >= 0.5 THEN 'MILD' ELSE 'SENSITIVE' END AS verdict FROM t""")
def sensitivity_tipping(df):
    """Where the coefficient of that sweep changes sides of 0.02, and where its interval starts or ceases to hold it."""
    t = ensemble.sensitivity_summary(_swept(df), 0.02)
    return t.select("feature", *[F.round(c, 6).alias(c) for c in ("coef", "least", "greatest")], "sign_tip", "interval_tip", "verdict")


CELLS = [-2.0, 0.0, 1.5]


def _cells_newton(steps):
    """Newton's method for the logistic regressions of all cells (imputation i, shift d), on one standardised column with a ridge of 0.01."""
    parts = ["c AS (SELECT i, coalesce(x1, 10 + 2 * i) AS x, CASE WHEN y > 4000 THEN 1 WHEN y IS NOT NULL THEN 0 END AS b, (k % 13 - 6) / 3.0::DOUBLE - 0.1::DOUBLE * i AS t FROM {v}, range(1, 3) u(i))"]
    parts.append(f"z AS MATERIALIZED (SELECT i, d, (x - (SELECT avg(x) FROM c)) / (SELECT stddev_samp(x) FROM c) AS x, coalesce(b, CASE WHEN t < d THEN 1 ELSE 0 END) AS y FROM c, (SELECT unnest({CELLS})::DOUBLE AS d))")
    parts.append("b0 AS (SELECT DISTINCT i, d, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM z)")
    for k in range(steps):
        parts.append(f"""s{k} AS (SELECT i, d, a, b, sum(y - p) AS g0, sum((y - p) * x) - 0.01 * b AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 0.01 AS h11
  FROM (SELECT z.i, z.d, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM z JOIN b{k} ON z.i = b{k}.i AND z.d = b{k}.d) GROUP BY i, d, a, b),
b{k + 1} AS MATERIALIZED (SELECT i, d, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{k})""")
    return ", ".join(parts)


@query("m_customer", f"WITH {_cells_newton(8)} SELECT i::INT AS imputation, d AS shift, round(a - b * (SELECT avg(x) / stddev_samp(x) FROM c), 4) AS intercept, round(b / (SELECT stddev_samp(x) FROM c), 5) AS slope FROM b8")
def sensitivity_logistic_cells(df):
    """Logistic fits of two given imputations and three shifts, all cells together, to convergence."""
    done = df.withColumn("imputation", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("x1", F.coalesce("x1", 10.0 + 2 * F.col("imputation")))
    done = done.withColumn("b", F.when(F.col("y").isNotNull(), (F.col("y") > 4000).cast("int"))).withColumn("t", F.when(F.col("b").isNull(), (F.col("k") % 13 - 6) / F.lit(3.0) - 0.1 * F.col("imputation")))
    cells = sensitivity.logistic_cells(done, ["x1"], "b", "t", CELLS)
    rows = [(i + 1, s, round(float(cells.coef[i, k, 0]), 4) + 0.0, round(float(cells.coef[i, k, 1]), 5) + 0.0) for i in range(2) for k, s in enumerate(CELLS)]
    return df.sparkSession.createDataFrame(rows, "imputation int, shift double, intercept double, slope double")


@query("m_orders", """
WITH z AS (SELECT i, g, x1 AS x, CASE WHEN k % 6 > 0 THEN y_grp ELSE 3 + i + CASE WHEN k % 4 > 1 THEN 0.5 ELSE 0 END END + d * CASE WHEN k % 6 > 0 THEN 0 ELSE 1 END AS y, d FROM {v}, range(1, 3) t(i), (SELECT unnest([-1.0, 0.0, 2.0])::DOUBLE AS d) WHERE x1 IS NOT NULL),
g AS (SELECT i, d, g, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM z GROUP BY i, d, g),
q AS (SELECT i, d, sum(n) AS rows, sum(n - w * n * n) AS n, sum(x - w * n * x) AS x, sum(y - w * n * y) AS y, sum(xx - w * x * x) AS xx, sum(xy - w * x * y) AS xy, sum(yy - w * y * y) AS yy, sum(ln(1 + 0.7 * n)) AS l
  FROM (SELECT *, 0.7 / (1 + 0.7 * n) AS w FROM g) GROUP BY i, d),
b AS (SELECT *, (xy * n - x * y) / (xx * n - x * x) AS slope FROM q)
SELECT i::INT AS imputation, d AS shift, round(slope, 8) AS slope, round((y - slope * x) / n, 5) AS intercept, round((yy - slope * xy - (y - slope * x) / n * y) / rows, 5) AS sigma2, round(l, 3) AS logdet FROM b""")
def sensitivity_mixed_at_ratio(df):
    """Random-intercept regressions of two given imputations and three shifts at a given ratio of the variances, from one job."""
    done = df.filter("x1 IS NOT NULL").withColumn("imputation", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("r", (F.col("k") % 6 == 0).cast("double"))
    done = done.withColumn("y", F.when(F.col("r") == 0, F.col("y_grp")).otherwise(3 + F.col("imputation") + F.when(F.col("k") % 4 > 1, 0.5).otherwise(0.0)))
    shifts = [-1.0, 0.0, 2.0]
    cells = sensitivity.MixedCells(done, ["x1"], "y", "r", "g", shifts)
    sums = cells.sums({i: np.array([0.7]) for i in cells.order})
    rows = []
    for i in cells.order:
        for k, s in enumerate(shifts):
            _, _, theta, _, s2 = cells.at(i, k, 0.7, sums[i][0])
            slope = theta[1] * cells.scale[1] / cells.scale[0]
            rows.append((i, s, round(float(slope), 8), round(float(cells.center[1] + theta[0] * cells.scale[1] - slope * cells.center[0]), 5), round(float(s2 * cells.scale[1] ** 2), 5), round(float(sums[i][0][-2]), 3)))
    cells.release()
    return df.sparkSession.createDataFrame(rows, "imputation int, shift double, slope double, intercept double, sigma2 double, logdet double")
