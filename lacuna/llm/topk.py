"""Exact top-k search by columnar branch-and-bound.

Candidates lie in blocks in vertical layout (one row per dimension).  A block is
scored against a block of queries a few dimensions at a time; after each step
the products so far plus the largest possible rest (the product of the norms of
what remains of both vectors) bound every pair's score, pairs that cannot reach
the query's k-th best so far are dropped, and the survivors are compacted before
the next dimensions.  Dimensions are taken in order of their energy, so that the
rest shrinks quickly.

The cluster deals (query block, candidate block) pairs: both sides are repeated
by block, never row by row, and each task keeps k rows per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries; dimensions taken at a time.
BLOCK_ROWS = 8192
STEP = 16
_TILE = 512
#: Largest scores that doubles hold exactly.
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, vec: str, factor: float) -> DataFrame:
    """(id, v) with v the array of ``floor(factor * x)``; rows with a null id, null vector, or a null or non-finite component are gone."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.select(F.col("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(finite.isNotNull() & finite)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * factor).cast("long")).alias("v"))


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates (query row, candidate row, score) of each query, never itself; ties to the smaller id.

    q: queries x dimensions, c: dimensions x candidates (vertical), whole numbers.
    Scores beyond 64 bits are reported as the nearest long.
    """
    dims = q.shape[1]
    order = np.argsort(-(np.square(c.astype(np.float64)).sum(1) * np.square(q.astype(np.float64)).sum(0)), kind="stable") if dims else np.empty(0, int)
    q, c = q[:, order], c[order]
    bound = float(np.sqrt(np.square(q.astype(np.float64)).sum(1).max(initial=0)) * np.sqrt(np.square(c.astype(np.float64)).sum(0).max(initial=0)))
    # single precision while every partial sum is a whole number that it holds, doubles or longs beyond
    kind = np.float32 if bound < 1 << 23 else np.float64 if bound < _EXACT / 4 else object
    q, c = q.astype(kind), c.astype(kind)
    cuts = list(range(0, dims, step)) + [dims]
    q2, c2 = np.square(q.astype(np.float64)), np.square(c.astype(np.float64))
    rest_q = [np.sqrt(q2[:, b:].sum(1)) for b in cuts[1:]]
    rest_c = [np.sqrt(c2[b:].sum(0)) for b in cuts[1:]]
    out_q, out_c, out_s = [], [], []
    best = np.full((len(q), k), -np.inf)
    for t in range(0, c.shape[1], _TILE):
        part = c[:, t : t + _TILE]
        floor = best[:, -1] if k else np.full(len(q), np.inf)
        own = q_ids[:, None] == c_ids[None, t : t + _TILE]
        score = (q[:, : cuts[1]] @ part[: cuts[1]] if dims else np.zeros((len(q), part.shape[1]), kind)).astype(kind)
        alive = ~own
        if len(cuts) > 2:
            alive &= score.astype(np.float64) + rest_q[0][:, None] * rest_c[0][None, t : t + _TILE] * (1 + 1e-9) + 1e-6 >= floor[:, None]
        i, j = np.nonzero(alive)
        s = score[i, j]
        for n in range(1, len(cuts) - 1):
            if not len(i):
                break
            a, b = cuts[n], cuts[n + 1]
            if 4 * len(i) > score.size:
                s = s + (q[:, a:b] @ part[a:b])[i, j]
            else:
                s = s + (q[i, a:b] * part[a:b, j].T).sum(1)
            if n + 1 < len(cuts) - 1:
                reach = s.astype(np.float64) + rest_q[n][i] * rest_c[n][t + j] * (1 + 1e-9) + 1e-6 >= floor[i]
                i, j, s = i[reach], j[reach], s[reach]
        near = s.astype(np.float64) >= floor[i]
        i, j, s = i[near], j[near] + t, s[near]
        if not len(i):
            continue
        out_q.append(i)
        out_c.append(j)
        out_s.append(s)
        by = np.lexsort((-s.astype(np.float64), i))
        place = np.arange(len(i)) - np.searchsorted(i[by], i[by])
        top = place < k
        fresh = np.full_like(best, -np.inf)
        fresh[i[by][top], place[top]] = s[by][top].astype(np.float64)
        best = -np.sort(-np.concatenate([best, fresh], 1), axis=1)[:, :k]
    if not out_q:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64)
    i, j, s = np.concatenate(out_q), np.concatenate(out_c), np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in np.concatenate(out_s)], np.int64)
    by = np.lexsort((c_ids[j], -s, i))
    i, j, s = i[by], j[by], s[by]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], s[kept]


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    values = table.column("v").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dims)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all candidates but its own id.

    Both sides are (id, v) rows of whole numbers; ids name rows.  Vectors meet only vectors of
    their length.  Fewer than k candidates give them all; ties go to the smaller
    id; rows repeated under one id count as often as they stand; no queries or no
    candidates give an empty result.
    """
    n_q, n_c = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, math.ceil(n_q / block_rows)), max(1, math.ceil(n_c / block_rows))

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        rows = rows.withColumn("dims", F.size("v")).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            i, j, s = (np.empty(0, np.int64),) * 3
        else:
            dims = left.column("dims")[0].as_py()
            q, c = _matrix(left, dims), _matrix(right, dims)
            q_ids, c_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            i, j, s = search_block(q_ids, q, c_ids, np.ascontiguousarray(c.T), k)
            i, j = q_ids[i], c_ids[j]
        return pa.table({"query_id": pa.array(i, pa.int64()), "vec_id": pa.array(j, pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ["q_block", "c_block", "dims"]
    left = dealt(queries, "q_block", q_blocks, "c_block", c_blocks).groupBy(*keys)
    right = dealt(candidates, "c_block", c_blocks, "q_block", q_blocks).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = 20, factor: float = 64.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``top_k`` of the rows of ``vectors`` that fulfil ``is_query`` (a condition on ``id``) against all rows."""
    rows = quantised(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec", factor)
    return top_k(rows.filter(is_query), rows, k, block_rows)


def sql() -> str:
    """DuckDB SQL of query op9."""
    return """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
