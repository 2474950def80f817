"""The neighbour join by pivots against comparing all, and how much it skips."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.operators import neighbors
from lacuna.plans import pivots


def _frame(spark, x, s, first=0):
    rows = [(first + i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, s, strict=True))]
    return spark.createDataFrame(rows, "k long, " + "".join(f"f{j} double, " for j in range(x.shape[1])) + "s double")


def _want(x, s, q, t, k, digits):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2) + s[None] + t[:, None]).round(digits)
    return {i: [(int(j), float(d[i, j])) for j in np.argsort(d[i], kind="stable")[:k]] for i in range(len(q))}


def _got(found):
    out: dict = {}
    for r in found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("d", "k"))).filter("rank <= 7").orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.k, r.d))
    return out


@pytest.mark.parametrize("cell_rows,block", [(40, 32_768), (200, 50), (10_000, 32_768)])
def test_join_equals_brute_force(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(pivots, "TRAIN_ROWS", block)
    monkeypatch.setattr(pivots, "QUERY_ROWS", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3)) * [1, 2, 0.1] + rng.integers(0, 4, (900, 1)) * 3
    x[100:500] = x[5]  # a third of the rows in one place: ties to the smaller key
    s = np.where(rng.random(900) < 0.3, rng.random(900) * 4, 0)
    q, t = x[rng.permutation(900)[:150]] + rng.normal(size=(150, 3)) * 0.05, rng.random(150)
    found = pivots.join(_frame(spark, x, s), _frame(spark, q, t), "k", "k", 3, 7, 6, cell_rows)
    assert _got(found) == _want(x, s, q, t, 7, 6)


def test_most_cells_are_skipped(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 2))
    train = _frame(spark, x, np.zeros(8000))
    cells, _ = pivots.Cells.of(train, "k", 2, 5, 100)
    queries = train.filter("k % 10 = 0").withColumnRenamed("k", "query")
    n = cells.visits(queries).select(F.sum(F.size("_visits")).alias("v"), F.count("*").alias("n")).first()
    assert len(cells.pivots) == 80 and n.v < 0.25 * n.n * 80


def test_few_rows(spark):
    train, none = _frame(spark, np.array([[1.0], [2.0]]), np.zeros(2)), _frame(spark, np.zeros((1, 1)), np.zeros(1)).limit(0)
    query = _frame(spark, np.array([[1.6]]), np.ones(1))
    got = neighbors.nearest(train, query, "k", "k", 1, 5).orderBy("rank").collect()
    assert [(r.query, r.k, r["rank"]) for r in got] == [(0, 1, 1), (0, 0, 2)]
    assert neighbors.nearest(none, query, "k", "k", 1, 5).collect() == [] and neighbors.nearest(train, none, "k", "k", 1, 5).collect() == []
