import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import topk


@pytest.mark.parametrize("scale", [1, 1e5, 1e8])
def test_block_search_equals_sorting(scale):
    rng = np.random.default_rng(6)
    c = np.floor(rng.normal(size=(900, 40)) * scale).astype(np.int64)
    c[5] = c[700]
    q = c[:30]
    ids = np.arange(900) * 3
    i, j, s = topk.search_block(ids[:30], q, ids, np.ascontiguousarray(c.T), 7, step=8)
    for r in range(30):
        scores = [(-sum(int(a) * int(b) for a, b in zip(q[r], v, strict=True)), k) for k, v in enumerate(c) if k != r]
        want = [(k, -v) for v, k in sorted(scores)[:7]]
        assert list(zip(j[i == r].tolist(), s[i == r].tolist(), strict=True)) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [1.0, 0.5]), (4, None), (40, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (60, [1.0]), (7, [-1.0, 0.25])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.search(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=2, block_rows=2).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(0, 1, 3, 5120), (0, 2, 20, 5120), (20, 1, 0, 5120), (20, 2, 3, 5120)}
    assert topk.search(df.limit(0), "vec_id", "embedding", F.col("id") % 20 == 0).collect() == []
