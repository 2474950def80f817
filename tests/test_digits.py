"""Fits without a penalty reach the maximum itself, not only as near as a log-likelihood tells."""

import duckdb
import numpy as np

from lacuna.catalog.checked import MONOTONE, _monotone
from lacuna.operators import explain
from lacuna.plans import gaussian
from lacuna.plans.patterns import Block, Patterns
from lacuna.sources.ingest import masked, masked_sql

SF = "/root/testdata/sf0.01"


def _sql(what):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{SF}/orders.parquet')")
    return con.execute((MONOTONE + what).replace("{v}", masked_sql("m_mono"))).fetchone()


def test_a_linear_fit_with_gaps_has_the_digits_of_its_closed_form(spark):
    m = _monotone(masked(spark, SF, "m_mono")).models[0]
    want = _sql("SELECT b0, b1, b2, m1, m2, v11, v12, v22, sigma2 FROM c")
    got = [m.intercept, *m.coef, *m.mu, m.sigma[0, 0], m.sigma[0, 1], m.sigma[1, 1], m.sigma2]
    np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-10)


def test_the_moments_of_an_explainer_have_the_digits_of_their_closed_form(spark):
    df = masked(spark, SF, "m_mono")
    e = explain.fit(_monotone(df), df, ["x1", "x2"])
    want = _sql("SELECT n1 + s12 / s22 * (m2 - n2), m2, s11 - s12 * s12 / s22 + pow(s12 / s22, 2) * v22, s12 / s22 * v22, v22 FROM c, o")
    np.testing.assert_allclose([*e.mu, e.sigma[0, 0], e.sigma[0, 1], e.sigma[1, 1]], want, rtol=1e-10, atol=1e-10)


def test_columns_that_determine_each_other_keep_the_ridge():
    x = np.random.default_rng(1).normal(size=(50, 1)) @ np.ones((1, 2))
    p = Patterns(["a", "b"], np.zeros(2), np.ones(2), {"00": Block(np.arange(2), 50.0, x.sum(0), x.T @ x)})
    plain, settled = gaussian.em(p, 500, 1e-10, 1e-8), gaussian.em(p, 500, 1e-10, 1e-8, settle=True)
    assert np.array_equal(plain.sigma, settled.sigma) and np.linalg.eigvalsh(settled.sigma)[0] > 0
