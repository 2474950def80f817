"""Queries on patterns, validation, diagnostics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import diagnostics as D
from lacuna.sources.ingest import masked, masked_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

X3 = ["x1", "x2", "x3"]


def query(view: str, sql: str | None = None):
    """Registers ``f(df)`` as a query over a masked view; ``{v}`` in the SQL is that view."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(masked(spark, sf_dir, view))
        if sql:
            ORACLES[f.__name__] = sql.replace("{v}", masked_sql(view))
        return f

    return add


@query("m_lineitem", """
SELECT concat(CASE WHEN x1 IS NULL THEN '1' ELSE '0' END, CASE WHEN x2 IS NULL THEN '1' ELSE '0' END, CASE WHEN x3 IS NULL THEN '1' ELSE '0' END, CASE WHEN y_lin IS NULL THEN '1' ELSE '0' END) AS pattern,
  concat_ws(',', CASE WHEN x1 IS NULL THEN 'x1' END, CASE WHEN x2 IS NULL THEN 'x2' END, CASE WHEN x3 IS NULL THEN 'x3' END, CASE WHEN y_lin IS NULL THEN 'y_lin' END) AS missing_cols,
  count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM {v} GROUP BY 1, 2""")
def pattern_summary(df):
    return D.pattern_summary(df, [*X3, "y_lin"])


@query("m_lineitem", """
SELECT count(*) AS n, count(*) FILTER (x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL) AS n_complete, count(*) FILTER (x1 IS NULL OR x2 IS NULL OR x3 IS NULL) AS n_partial,
  count(*) FILTER (x1 IS NULL) AS missing_x1, round(avg((x1 IS NULL)::INT), 6) AS rate_x1, count(*) FILTER (x2 IS NULL) AS missing_x2, round(avg((x2 IS NULL)::INT), 6) AS rate_x2,
  count(*) FILTER (x3 IS NULL) AS missing_x3, round(avg((x3 IS NULL)::INT), 6) AS rate_x3 FROM {v}""")
def missingness_report(df):
    return D.missingness_report(df, X3)


LONG = "(SELECT 'x1' AS feature, x1 AS value FROM {v} UNION ALL SELECT 'x2', x2 FROM {v} UNION ALL SELECT 'x3', x3 FROM {v})"


@query("m_lineitem", f"""
WITH s AS (SELECT feature, count(*) AS n, count(value) AS n_obs, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, max(abs(value)) AS top FROM {LONG} GROUP BY 1)
SELECT feature, n, n_obs, round(lo, 4) AS lo, round(hi, 4) AS hi, round(sd, 4) AS sd, n_obs < 2 OR hi = lo AS constant,
  n_obs < 2 OR hi = lo OR sd <= 1e-12 * top AS degenerate, round(CASE WHEN n_obs < 2 OR hi = lo OR sd <= 1e-12 * top THEN 1 ELSE sd END, 4) AS scale FROM s""")
def column_profile(df):
    return D.column_profile(df, X3)


MOMENTS = """
WITH c AS (SELECT feature, value, avg(value) OVER (PARTITION BY feature) AS m FROM {L}),
s AS (SELECT feature, count(value) AS n_obs, count(DISTINCT value) AS n_distinct, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS skew, kurtosis_pop(value) AS kurt FROM c GROUP BY 1)
SELECT feature, n_obs, n_distinct, round(skew, 4) AS skew, round(kurt, 4) AS kurt, n_obs >= 8 AND n_distinct >= 3 AND (abs(skew) > 1 OR abs(kurt) > 2) AS needs_copula FROM s"""


@query("m_events", MOMENTS.replace("{L}", "(SELECT 'y' AS feature, y AS value FROM {v} UNION ALL SELECT 'x1', x1 FROM {v} UNION ALL SELECT 'x2', x2 FROM {v})"))
def needs_copula(df):
    return D.moments(df, ["y", "x1", "x2"])


@query("m_part", """
WITH s AS (SELECT count(*) AS n, count(x1) AS n1, count(DISTINCT x1) AS d1, stddev_samp(x1) AS s1, kurtosis_pop(x1) AS k1, count(*) FILTER (x1 <> floor(x1)) AS f1,
  count(x2) AS n2, count(DISTINCT x2) AS d2, stddev_samp(x2) AS s2, kurtosis_pop(x2) AS k2, count(*) FILTER (x2 <> floor(x2)) AS f2, count(y) AS ny FROM {v}), r AS (
SELECT 'error' AS level, 'x1' AS "column", 'all_missing' AS code, n1 = 0 AS hit FROM s UNION ALL SELECT 'error', 'x1', 'constant', d1 = 1 FROM s UNION ALL SELECT 'note', 'x1', 'binary', d1 = 2 FROM s
UNION ALL SELECT 'warning', 'x1', 'categorical', d1 > 2 AND d1 <= 10 AND f1 = 0 FROM s UNION ALL SELECT 'warning', 'x1', 'mostly_missing', 1 - n1 / n > 0.7 FROM s
UNION ALL SELECT 'warning', 'x1', 'tiny_spread', d1 > 1 AND s1 < 1e-6 FROM s UNION ALL SELECT 'note', 'x1', 'heavy_tails', abs(k1) > 7 FROM s
UNION ALL SELECT 'error', 'x2', 'all_missing', n2 = 0 FROM s UNION ALL SELECT 'error', 'x2', 'constant', d2 = 1 FROM s UNION ALL SELECT 'note', 'x2', 'binary', d2 = 2 FROM s
UNION ALL SELECT 'warning', 'x2', 'categorical', d2 > 2 AND d2 <= 10 AND f2 = 0 FROM s UNION ALL SELECT 'warning', 'x2', 'mostly_missing', 1 - n2 / n > 0.7 FROM s
UNION ALL SELECT 'warning', 'x2', 'tiny_spread', d2 > 1 AND s2 < 1e-6 FROM s UNION ALL SELECT 'note', 'x2', 'heavy_tails', abs(k2) > 7 FROM s
UNION ALL SELECT 'error', 'y', 'all_missing', ny = 0 FROM s UNION ALL SELECT 'note', 'y', 'missing_label', ny > 0 AND ny < n FROM s
UNION ALL SELECT 'warning', '*', 'few_rows', ny < 2 FROM s UNION ALL SELECT 'warning', '*', 'scales_apart', greatest(s1, s2) / least(s1, s2) > 1000 FROM s)
SELECT level, "column", code FROM r WHERE hit""")
def prefit_report(df):
    return D.prefit_report(df, ["x1", "x2"], "y")


@query("m_customer", """
WITH c AS (SELECT l, (row_number() OVER (ORDER BY l) - 1)::INT AS code FROM (SELECT DISTINCT x1 AS l FROM {v} WHERE x1 IS NOT NULL))
SELECT k, x1 AS label, code FROM {v} LEFT JOIN c ON x1 = l""")
def label_encode(df):
    return D.label_encode(df, "k", "x1")


@query("m_customer", """
SELECT k, CASE WHEN g IS NOT NULL THEN (g = 'BUILDING')::INT::DOUBLE END AS g_BUILDING, CASE WHEN g IS NOT NULL THEN (g = 'FURNITURE')::INT::DOUBLE END AS g_FURNITURE
FROM (SELECT k, CASE WHEN k % 8 >= 2 THEN g END AS g FROM {v})""")
def onehot_encode(df):
    df = df.select("k", F.when(F.col("k") % 8 >= 2, F.col("g")).alias("g"))
    return D.onehot(df, "g", ["AUTOMOBILE", "BUILDING", "FURNITURE"], ("k",))


@query("m_lineitem", """
SELECT * FROM (SELECT 'x1' AS a, 'x1' AS b, count(x1) AS n, round(covar_samp(x1, x1), 2) AS cov FROM {v} UNION ALL SELECT 'x1', 'x2', count(*) FILTER (x1 IS NOT NULL AND x2 IS NOT NULL), round(covar_samp(x1, x2), 2) FROM {v}
UNION ALL SELECT 'x1', 'x3', count(*) FILTER (x1 IS NOT NULL AND x3 IS NOT NULL), round(covar_samp(x1, x3), 2) FROM {v} UNION ALL SELECT 'x2', 'x2', count(x2), round(covar_samp(x2, x2), 2) FROM {v}
UNION ALL SELECT 'x2', 'x3', count(*) FILTER (x2 IS NOT NULL AND x3 IS NOT NULL), round(covar_samp(x2, x3), 2) FROM {v} UNION ALL SELECT 'x3', 'x3', count(x3), round(covar_samp(x3, x3), 2) FROM {v})""")
def pairwise_cov(df):
    return D.pairwise_cov(df, X3).withColumn("cov", F.round("cov", 2))


@query("m_lineitem", """
WITH f AS (SELECT (x1 IS NULL)::INT AS a, (x2 IS NULL)::INT AS b, (x3 IS NULL)::INT AS c FROM {v})
SELECT 'x1' AS a, 'x2' AS b, round(coalesce(corr(a, b), 0), 6) + 0 AS phi FROM f UNION ALL SELECT 'x1', 'x3', round(coalesce(corr(a, c), 0), 6) FROM f UNION ALL SELECT 'x2', 'x3', round(coalesce(corr(b, c), 0), 6) FROM f""")
def missing_phi(df):
    return D.missing_phi(df, X3).withColumn("phi", F.round("phi", 6))


@query("m_part", """
WITH m AS (SELECT avg(x1) AS m1, avg(y) AS m2, var_samp(x1) + 1e-8 AS v1, var_samp(y) + 1e-8 AS v2, covar_samp(x1, y) AS c FROM {v}),
p AS (SELECT x1 IS NULL AS a, y IS NULL AS b, count(*) AS n, avg(x1) AS a1, avg(y) AS a2 FROM {v} GROUP BY 1, 2),
d AS (SELECT CASE WHEN NOT a AND NOT b THEN n * (v2 * pow(a1 - m1, 2) - 2 * c * (a1 - m1) * (a2 - m2) + v1 * pow(a2 - m2, 2)) / (v1 * v2 - c * c)
  WHEN NOT a THEN n * pow(a1 - m1, 2) / v1 WHEN NOT b THEN n * pow(a2 - m2, 2) / v2 ELSE 0 END AS d, (NOT a)::INT + (NOT b)::INT AS o FROM p, m WHERE n >= 2)
SELECT round(sum(d), 4) AS d2, greatest(1, sum(o) - 2)::INT AS df FROM d""")
def little_mcar_d2(df):
    return D.little_test(df, ["x1", "y"]).select(F.round("d2", 4).alias("d2"), "df")


@query("m_part", """
WITH r AS (SELECT x2 AS v, x1 IS NULL AS m, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2 AS r FROM {v} WHERE x2 IS NOT NULL)
SELECT count(*) FILTER (m) AS n_missing, count(*) FILTER (NOT m) AS n_observed, round(avg(v) FILTER (m), 4) AS mean_missing, round(avg(v) FILTER (NOT m), 4) AS mean_observed,
  round(sum(r) FILTER (m) - count(*) FILTER (m) * (count(*) FILTER (m) + 1) / 2, 2)::DOUBLE AS u FROM r""")
def mannwhitney_u(df):
    r = D.rank_sums(df, "x2", "x1")
    return r.select("n_missing", "n_observed", F.round("mean_missing", 4).alias("mean_missing"), F.round("mean_observed", 4).alias("mean_observed"), F.round("u", 2).alias("u"))


@query("m_lineitem", f"""
WITH s AS (SELECT feature, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing FROM {LONG} GROUP BY 1)
SELECT feature, n, n_missing, round(n * (n_missing / n * ln(n_missing / n) + (1 - n_missing / n) * ln(1 - n_missing / n)), 4) AS loglik FROM s""")
def mar_null_loglik(df):
    return D.null_loglik(df, X3).withColumn("loglik", F.round("loglik", 4))


@query("m_customer")
def mar_lr_test(df):
    return D.mar_plausibility(df, ["y", "x1"])


@query("m_part")
def diagnostic_report(df):
    found = D.run_all(df, ["x1", "x2", "y"])
    t = found["little"].first()
    rows = [("little", "d2", float(t["d2"])), ("little", "p_value", float(t["p_value"])), ("verdict", found["verdict"], 0.0)]
    rows += [("mar", r["feature"], float(r["p_value"])) for r in found["mar"].collect()]
    return df.sparkSession.createDataFrame(rows, "section string, key string, value double")


@query("m_customer", "SELECT k, row_number() OVER (ORDER BY y IS NULL, y, x1 IS NULL, x1, k)::INT AS position FROM {v}")
def canonical_order(df):
    ordered = df.select("k", "y", "x1").sort(*D.canonical_order(df, ["y", "x1"]), "k")
    from lacuna.operators.resampling import numbered

    return numbered(ordered, [*D.canonical_order(df, ["y", "x1"]), F.col("k")]).select("k", F.col("position").cast("int"))


@query("m_orders", """
WITH g AS (SELECT g, count(*) AS n, avg(y_grp) AS m, sum(y_grp) AS s, sum(y_grp * y_grp) AS q FROM {v} WHERE y_grp IS NOT NULL GROUP BY 1),
t AS (SELECT count(*) AS groups, sum(n)::BIGINT AS n, sum(s) AS s, sum(n * m * m) AS b, sum(q) AS q FROM g),
v AS (SELECT groups, n, (b - s * s / n) / (groups - 1) AS msb, (q - b) / (n - groups) AS msw FROM t)
SELECT groups, n, round(greatest(0, (msb - msw) / (n / groups)) / (greatest(0, (msb - msw) / (n / groups)) + msw), 6) AS icc FROM v""")
def icc(df):
    return D.icc(df, "y_grp", "g").withColumn("icc", F.round("icc", 6))


@query("m_lineitem", """
WITH s AS (SELECT count(DISTINCT y_bin) AS d, count(*) FILTER (y_bin <> floor(y_bin)) AS f, count(*) FILTER (y_bin NOT IN (0, 1)) AS o FROM {v} WHERE y_bin IS NOT NULL)
SELECT CASE WHEN o = 0 THEN 'classification' ELSE 'regression' END AS zero_one, CASE WHEN f = 0 AND d <= 20 THEN 'classification' ELSE 'regression' END AS whole_numbers,
  CASE WHEN d <= 2 OR (f = 0 AND d <= 20) THEN 'classification' ELSE 'regression' END AS recommended FROM s""")
def task_detect(df):
    return D.task_rules(df, "y_bin")


@query("m_lineitem", """
WITH s AS (SELECT feature, count(value) / count(*) AS share FROM """ + LONG + """ GROUP BY 1)
SELECT feature, round(share, 6) AS share, round(share / sum(share) OVER (), 6) AS importance FROM s""")
def availability_importance(df):
    from lacuna.operators.results import normalised

    rows = D.long_form(df, X3).groupBy("feature").agg((F.count("value") / F.count("*")).alias("share"))
    return normalised(rows, "share").select("feature", F.round("share", 6).alias("share"), F.round("importance", 6).alias("importance"))
