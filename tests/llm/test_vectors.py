"""Codes, whitening and graph search against brute force, with odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import codes, graph, queries, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (None, [1.0, 0.0, 0.5, 0.25]), (901, [NAN, 1.0, 0.0, 0.0]), (902, [1.0, None, 0.0, 0.0]), (903, [INF, 0.0, 0.0, 0.0]), (904, [1.0]), (905, []), (906, [0.0] * 4)]


@pytest.fixture(scope="module")
def matrix(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), [r.label for r in rows]


def _frame(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame([(i, v, "mine", 7) for i, v in rows + ODD], "vec_id long, v array<double>, code string, Row int")


def _lloyd(ids, x, parts, entries, rounds, factor):
    """Plain Lloyd over Python integers: (codebooks, codes, errors)."""
    q = [[int(np.floor(factor * c)) for c in v] for v in x]
    cut = [p * len(q[0]) // parts for p in range(parts + 1)]
    first = sorted(range(len(q)), key=lambda i: (ids[i] is None, ids[i] or 0, q[i]))[:entries]
    books = [[q[i][a:b] for i in first] for a, b in zip(cut, cut[1:], strict=False)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [(nearest(v[cut[p] : cut[p + 1]], books[p])[1], v[cut[p] : cut[p + 1]]) for v in q]
            for e in range(len(first)):
                mine = [v for k, v in own if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(v[cut[p] : cut[p + 1]], books[p]) for p in range(parts)] for v in q]
    return books, ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found]


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e14])
def test_codes_equal_plain_lloyd(spark, scale):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(150, 4)), 2) * scale
    x[20:60] = x[3]  # a group of copies
    ids = rng.permutation(150)
    rows = _frame(spark, x, ids).repartition(5)
    book = codes.fit(rows, "vec_id", "v", parts=3, entries=5, rounds=4, factor=100.0, block_rows=16)
    want, code, error = _lloyd([*ids.tolist(), None, 906], [*x, [1.0, 0.0, 0.5, 0.25], [0.0] * 4], 3, 5, 4, 100.0)
    assert book.entries == want and book.cuts == [0, 1, 2, 4]
    out = codes.encode(rows, "v", book)
    assert out.columns == ["vec_id", "v", "Row", "code", "error"]
    got = {r.vec_id: (r.code, r.error) for r in out.collect()}
    assert got == dict(zip([*ids.tolist(), None, 906], zip(code, [min(e, 2**63 - 1) for e in error], strict=True), strict=True))
    back = codes.decode(out, "code", book, "back").filter("vec_id = 3").first()
    assert len(back.back) == 4


def test_codes_of_few_and_no_vectors(spark):
    rows = spark.createDataFrame([(2, [1.0, 2.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    book = codes.fit(rows, "id", "v")
    assert [len(p) for p in book.entries] == [2] * 8 and book.rounds == 1
    assert sorted(r.error for r in codes.encode(rows, "v", book).collect()) == [0, 0]
    assert codes.fit(rows.limit(0), "id", "v") is None
    with pytest.raises(ValueError, match="entries"):
        codes.fit(rows, "id", "v", entries=300)


def test_rounds_shuffle_no_vectors(spark):
    """The vectors and the last assignments lie in the same buckets."""
    from lacuna.llm.shared import bucketed, discard

    base = spark.range(1000).selectExpr("id AS block", "cast('x' AS binary) AS data").repartition(3, "block")
    (a, left), (b, right) = bucketed(base, "block", 3), bucketed(base.withColumnRenamed("data", "codes"), "block", 3)
    joined = left.hint("merge").join(right, "block")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 1000
    discard(a)
    discard(b)


def test_label_sums_take_nulls_together(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 5), (None, 1), (None, 2), (1, 7)], "label int, error long")
    for most in (10, 0):
        monkeypatch.setattr(codes, "BROADCAST_GROUPS", most)
        assert sorted(tuple(r) for r in codes.summed_by(rows, "label", "error", "s").fillna(0, "label").collect()) == [(0, 1, 3), (0, 2, 3), (1, 5, 12), (1, 7, 12)]


def test_merged_svd_equals_one_svd():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + 1e4
    parts = [whitening.Summary.of(p) for p in np.split(x, [1, 4, 100, 101, 250])]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.merge(p)
    mean = x.mean(0)
    assert np.allclose(all_.mean, mean, rtol=1e-14)
    assert np.allclose((all_.vt.T * all_.s**2) @ all_.vt, (x - mean).T @ (x - mean), rtol=1e-9) and len(all_.s) == 7


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_whitening_equals_numpy(spark, parts):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.5] + 3
    x[50:120] = x[0]
    rows = _frame(spark, x).repartition(parts)
    model = whitening.fit(rows, "v", components=3)
    q = np.floor(256 * np.vstack([x, [[1.0, 0.0, 0.5, 0.25], [0.0] * 4]])).astype(np.int64)
    u = np.unique(q, axis=0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True))
    assert model.n == len(u) and model.sums == u.sum(0).tolist() and model.identity_error < 1e-9
    assert np.allclose(model.explained, e[::-1][:3] / e.sum(), rtol=1e-9)
    out = whitening.apply(rows.withColumn("Whitened", F.lit(1)), "v", model)
    assert out.columns == ["vec_id", "v", "code", "Row", "whitened", "deviation"]
    got = {r.vec_id: r for r in out.collect()}
    z = (q - u.sum(0) / len(u)) @ v[:, ::-1][:, :3] / np.sqrt(e[::-1][:3])
    for i, k in enumerate([*range(200), None, 906]):
        assert np.allclose(np.abs(got[k].whitened), np.abs(z[i]), atol=1e-8)
        assert got[k].deviation == sum((len(u) * int(a) - int(s)) ** 2 for a, s in zip(q[i], u.sum(0), strict=True))


def test_whitening_without_variance(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    model = whitening.fit(rows, "v")
    assert model.n == 1 and model.explained == [None, None] and model.identity_error == 0
    assert {(tuple(r.whitened), r.deviation) for r in whitening.apply(rows, "v", model).collect()} == {((None, None), 0)}
    flat = whitening.fit(rows.union(spark.createDataFrame([(3, [2.0, 2.0])], rows.schema)), "v")
    assert flat.spread.tolist() == [True, False] and flat.identity_error < 1e-12
    assert whitening.fit(rows.limit(0), "v") is None
    huge = spark.createDataFrame([(1, [1e17, 0.0]), (2, [-1e17, 0.0])], "id long, v array<double>")
    assert {r.deviation for r in whitening.apply(huge, "v", whitening.fit(huge, "v")).collect()} == {2**63 - 1}


def test_query_whitens_to_identity(spark, matrix):
    ids, x, _ = matrix
    rows = queries.op12_whiten(spark, SF).collect()
    assert len(rows) == 4 * len(ids) and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    z = np.zeros((len(ids), 4))
    for r in rows:
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(np.cov(z.T, bias=True), np.eye(4), atol=1e-9)  # every vector of this table stands once


def _brute(ids, x, queries_, k):
    want = {}
    for i in queries_:
        scores = [(-float(x[i] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
        want[ids[i]] = [(j, -s) for s, j in sorted(scores)[:k]]
    return want


def test_query_finds_the_nearest(spark, matrix):
    ids, x, _ = matrix
    want = _brute(ids.tolist(), x, [i for i in range(len(ids)) if ids[i] % 20 == 0], 20)
    got: dict = {}
    for r in queries.op13_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and {len(v) for v in got.values()} == {20}
    right = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) / (20 * len(want))
    assert right >= 0.99
    for q, found in got.items():
        assert all(abs(s - x[q] @ x[j]) < 1e-12 for j, s in found) and [(-s, j) for j, s in found] == sorted((-s, j) for j, s in found)


def test_graph_recall_over_shards(spark):
    """Harder vectors of unequal norms over many shards, with a group of copies that no list of neighbours could hold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)) * rng.lognormal(sigma=0.3, size=(3000, 1))
    x[500:1500] = x[7]
    ids = rng.permutation(3000).tolist()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>").repartition(7)
    graphs = graph.index(rows, "vec_id", "v", shard_rows=400)
    assert graphs.select("shard").distinct().count() == 8
    out = graph.nearest(graphs, rows.filter("vec_id % 50 = 0"), "vec_id", "v", k=10).collect()
    queries_ = [i for i in range(3000) if ids[i] % 50 == 0]
    want = _brute(ids, x, queries_, 10)
    right = sum(round(s, 9) >= round(want[q][-1][1], 9) for q, s in ((r.query_id, r.score) for r in out)) / (10 * len(queries_))
    assert len(out) == 10 * len(queries_) and right > 0.97
    copies = [q for q in queries_ if 500 <= q < 1500 or q == 7]
    for q in copies[:5]:  # all copies tie: the smaller ids
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == ids[q]), key=lambda r: r["rank"])] == [j for j, _ in want[ids[q]]]


def test_graph_of_odd_and_few_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.5], "x"), (20, [1.0, 0.5], "x"), (3, [-1.0, 0.5], "x"), (3, [0.5, 0.5], "x"), (40, [0.0, 0.0], "x"), (60, None, "x"), (80, [1.0], "x"), (100, [NAN, 1.0], "x"), (None, [1.0, 1.0], "x")], "vec_id long, v array<float>, score string")
    graphs = graph.index(rows, "vec_id", "v", shard_rows=2)
    out = graph.nearest(graphs, rows.filter("vec_id % 20 = 0"), "vec_id", "v", k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(0, 1, 20, 1.25), (0, 2, 3, 0.75), (0, 3, 3, -0.75), (20, 1, 0, 1.25), (20, 2, 3, 0.75), (20, 3, 3, -0.75)]
    none = rows.limit(0)
    assert graph.nearest(graph.index(none, "vec_id", "v"), rows, "vec_id", "v").collect() == []
    assert graph.nearest(graphs, none, "vec_id", "v").collect() == []


@pytest.mark.parametrize("name", ["op11_codes", "op12_whiten", "op13_neighbours"])
def test_queries_on_an_empty_table(spark, tmp_path, name):
    full = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    empty = queries.QUERIES[name](spark, str(tmp_path))
    assert dict(empty.dtypes) == dict(full.dtypes) and empty.collect() == []
