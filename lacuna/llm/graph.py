"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt evenly to shards of bounded size.  In a shard equal vectors are
one node; a node's level is drawn with a fixed seed, and the nodes are
numbered by falling level, so that every layer's nodes are the first of them and
a layer is one flat array of neighbour numbers (-1 where a node has fewer).
Layers are built from the top; nodes come in batches, which search the layer so
far from where the layer above leads, choose diverse neighbours and are linked
back.  Searches walk many queries at a time.  An index is a table of such arrays,
cut into pieces of bounded size; every block of queries searches every shard, and
the shards' results are merged.

Nearness is the inner product.  So that the nearest are close in the graph's own
sense, nodes get one more component, which makes all norms of a shard equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.llm import vectors
from lacuna.llm.shared import materialise, tidied

#: Rows of a shard at most, and components of all its vectors.
SHARD_ROWS = 16_384
SHARD_CELLS = 1 << 24
#: Neighbours of a node in upper layers (twice as many in the lowest); width of the beam while building and while searching.
DEGREE = 16
BUILD_BEAM = 96
SEARCH_BEAM = 192
#: Nodes opened at a time for each query; queries walked together; cells of their visited table.
OPENED = 4
WALK_ROWS = 512
VISITED_CELLS = 1 << 26
#: Nodes that begin a layer by comparing all, and nodes added at a time.
FIRST, BATCH = 256, 512
#: Bytes of a piece of an index; queries of a block, and blocks that meet a shard in one task.
PIECE_BYTES = 4 << 20
QUERY_ROWS, QUERY_BLOCKS = 1024, 64


@dataclass
class Graph:
    """points: nodes x (dims + 1); layers[l]: neighbours of the first nodes, from the lowest layer up."""

    points: np.ndarray
    layers: list[np.ndarray]


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first."""
    if score.shape[1] > k:
        some = np.argpartition(-score, k - 1, axis=1)[:, :k]
        by = np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable")
        return np.take_along_axis(some, by, 1)
    return np.argsort(-score, axis=1, kind="stable")


def walk(points: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of a layer for each query from its start nodes: (nodes, scores), best first, -1 where fewer were found."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(near)), bool)
    at = np.full((len(q), beam), -1, np.int32)
    score = np.full((len(q), beam), -np.inf, np.float32)
    width = min(start.shape[1], beam)
    at[:, :width] = start[:, :width]
    score[:, :width] = np.einsum("qd,qkd->qk", q, points[start[:, :width]])
    seen[rows[:, None], start[:, :width]] = True
    fresh = at >= 0
    live = rows
    while len(live):
        # the best nodes that are not yet opened, a few of each query
        turn = np.cumsum(fresh[live], 1)
        open_ = fresh[live] & (turn <= OPENED)
        r, c = np.nonzero(open_)
        if not len(r):
            break
        fresh[live[r], c] = False
        found = near[at[live[r], c]]
        rr = np.repeat(live[r], found.shape[1])
        vv = found.ravel()
        new = (vv >= 0) & ~seen[rr, vv]
        rr, vv = rr[new], vv[new]
        pair = np.sort(rr.astype(np.int64) * len(near) + vv)  # a node may be the neighbour of several opened ones
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        rr, vv = pair // len(near), (pair % len(near)).astype(np.int32)
        seen[rr, vv] = True
        value = np.einsum("nd,nd->n", q[rr], points[vv])
        good = value > score[rr, -1]
        rr, vv, value = rr[good], vv[good], value[good]
        if len(rr):
            own, first, count = np.unique(rr, return_index=True, return_counts=True)
            most = int(count.max())
            place = np.arange(len(rr)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(own)), count)
            more = np.full((len(own), most), -np.inf, np.float32)
            node = np.full((len(own), most), -1, np.int32)
            more[line, place], node[line, place] = value, vv
            all_score = np.concatenate([score[own], more], 1)
            all_at = np.concatenate([at[own], node], 1)
            all_fresh = np.concatenate([fresh[own], node >= 0], 1)
            keep = _best(all_score, beam)
            score[own] = np.take_along_axis(all_score, keep, 1)
            at[own] = np.take_along_axis(all_at, keep, 1)
            fresh[own] = np.take_along_axis(all_fresh, keep, 1)
        live = live[fresh[live].any(1)]
    return at, score


def diverse(points: np.ndarray, own: np.ndarray, at: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to it than to any chosen before, then the best of the rest: neighbours, -1 where fewer."""
    out = np.full((len(at), degree), -1, np.int32)
    for a in range(0, len(at), 256):
        c, s = at[a : a + 256], score[a : a + 256]
        p = points[np.maximum(c, 0)]
        pair = np.matmul(p, p.transpose(0, 2, 1))
        no = c < 0
        taken = np.zeros(c.shape, bool)
        shut = no.copy()
        count = np.zeros(len(c), int)
        for j in range(c.shape[1]):
            yes = ~shut[:, j] & (count < degree)
            taken[:, j] = yes
            count += yes
            shut |= yes[:, None] & (pair[:, j] > s)
        order = np.argsort(np.where(no, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :degree]
        out[a : a + 256, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _compared(points: np.ndarray, some: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``others`` for each of ``some``, itself excluded."""
    score = points[some] @ points[others].T
    score[some[:, None] == others[None]] = -np.inf
    keep = _best(score, k)
    s = np.take_along_axis(score, keep, 1)
    return np.where(np.isfinite(s), others[keep], -1).astype(np.int32), s


def _linked_back(points: np.ndarray, near: np.ndarray, new: np.ndarray) -> None:
    """Adds each new node to its neighbours' lists, which are chosen anew where they overflow."""
    degree = near.shape[1]
    src = np.repeat(new, degree)
    dst = near[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    value = np.einsum("nd,nd->n", points[src], points[dst])
    by = np.lexsort((-value, dst))
    src, dst = src[by], dst[by]
    own, first, count = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(first, count)
    few = place < degree
    more = np.full((len(own), degree), -1, np.int32)
    more[np.repeat(np.arange(len(own)), count)[few], place[few]] = src[few]
    known = near[own]
    more[(more[:, :, None] == known[:, None, :]).any(2)] = -1
    both = np.concatenate([known, more], 1)
    score = np.where(both >= 0, np.einsum("nd,nkd->nk", points[own], points[np.maximum(both, 0)]), -np.inf)
    by = np.argsort(-score, axis=1, kind="stable")
    both, score = np.take_along_axis(both, by, 1), np.take_along_axis(score, by, 1).astype(np.float32)
    fits = (both >= 0).sum(1) <= degree
    near[own[fits]] = both[fits, :degree]
    if not fits.all():
        near[own[~fits]] = diverse(points, own[~fits], both[~fits], score[~fits], degree)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[Graph, np.ndarray]:
    """The graph over the rows of ``x`` and the order it numbers them in."""
    n = len(x)
    x = np.asarray(x, np.float32)
    norm = np.square(x.astype(np.float64)).sum(1)
    points = np.concatenate([x, np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0))[:, None].astype(np.float32)], 1)
    draw = np.random.default_rng(n).random((2, n))
    level = np.floor(-np.log(draw[0] + 1e-12) / math.log(degree)).astype(int)
    order = np.lexsort((draw[1], -level))
    points, level = np.ascontiguousarray(points[order]), level[order]
    graph = Graph(points, [])
    sizes = [int((level >= f).sum()) for f in range(int(level.max(initial=0)) + 1)] if n else []
    for f in range(len(sizes) - 1, -1, -1):
        size, width = sizes[f], degree * (1 if f else 2)
        near = np.full((size, width), -1, np.int32)
        first = np.arange(min(size, FIRST))
        at, score = _compared(points, first, first, beam)
        near[first] = diverse(points, first, at, score, width)
        _linked_back(points, near, first)
        done = len(first)
        while done < size:
            new = np.arange(done, min(size, done + min(BATCH, done)))
            found, value = [], []
            step = max(1, min(len(new), VISITED_CELLS // size))
            for a in range(0, len(new), step):
                q = points[new[a : a + step]]
                start = descend(graph, q)
                at, score = walk(points, near, q, start if len(start) else np.zeros((len(q), 1), np.int32), beam)
                found.append(at)
                value.append(score)
            mates, close = _compared(points, new, new, min(beam, len(new)))
            at, score = np.concatenate([np.concatenate(found), mates], 1), np.concatenate([np.concatenate(value), close], 1)
            keep = _best(score, beam)
            at, score = np.take_along_axis(at, keep, 1), np.take_along_axis(score, keep, 1)
            near[new] = diverse(points, new, at, score, width)
            _linked_back(points, near, new)
            done += len(new)
        graph.layers.insert(0, near)
    return graph, order


def descend(graph: Graph, q: np.ndarray, floor: int = 0) -> np.ndarray:
    """From the top layer down to above ``floor``: the nodes where each query enters the layer below."""
    start = np.zeros((len(q), 1), np.int32)
    for near in reversed(graph.layers[floor:]):
        start = np.maximum(walk(graph.points, near, q, start, 4)[0][:, :1], 0)
    return start


def search(graph: Graph, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
    """About the k nearest nodes of each query, best first, -1 where there are fewer."""
    if not len(graph.points):
        return np.full((len(queries), 0), -1, np.int32)
    q = np.concatenate([np.asarray(queries, np.float32), np.zeros((len(queries), 1), np.float32)], 1)
    out = []
    step = max(1, min(WALK_ROWS, VISITED_CELLS // len(graph.points)))
    for a in range(0, len(q), step):
        some = q[a : a + step]
        start = descend(graph, some, 1) if len(graph.layers) > 1 else np.zeros((len(some), 1), np.int32)
        out.append(walk(graph.points, graph.layers[0], some, start, max(beam, k))[0][:, :k])
    return np.concatenate(out) if out else np.empty((0, k), np.int32)


def _usable(vec: str) -> Column:
    """Whole vectors that are not zero throughout."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    return F.when(F.exists(x, lambda c: c != 0), x)


def index(df: DataFrame, id_col: str, vec: str, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM) -> DataFrame:
    """(shard, dims, name, piece, data): the graphs of all shards, in pieces, written to the shared folder.

    Every row with an id and a whole vector other than zero is indexed; vectors
    of one length are one graph of a shard.  Rows are dealt by turns, so shards
    are even whatever ids or vectors repeat.
    """
    rows = vectors.kept(df.filter(F.col(id_col).isNotNull()), vec, _usable(vec)).select(F.col("row")[id_col].cast("long").alias("id"), "x")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    each = max(1, min(shard_rows, SHARD_CELLS // max(1, size["d"] or 1)))
    shards = max(1, math.ceil(size["n"] / each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list[np.ndarray]] = {}
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes):
                on = batch.filter(pa.array(sizes == d))
                ids.setdefault(int(d), []).append(on.column(0).to_numpy())
                held.setdefault(int(d), []).append(vectors.matrix(on.column(1), int(d), np.float64))
        for d in sorted(held):
            x, own = np.concatenate(held.pop(d)), np.concatenate(ids.pop(d))
            node_x, node = np.unique(x, axis=0, return_inverse=True)
            graph, order = build(node_x, degree, beam)
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            node = number[node.ravel()]
            by = np.lexsort((own, node))
            arrays = {"x": node_x[order], "ids": own[by].astype(np.int64), "ends": np.cumsum(np.bincount(node, minlength=len(order))).astype(np.int64)}
            arrays |= {f"layer{i}": near for i, near in enumerate(graph.layers)}
            for name, values in arrays.items():
                data = values.tobytes()
                for i, a in enumerate(range(0, len(data), PIECE_BYTES)):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "dims": pa.array([d], pa.int32()), "name": [name], "piece": pa.array([i], pa.int32()), "data": pa.array([data[a : a + PIECE_BYTES]], pa.binary())})

    return materialise(rows.repartition(shards).mapInArrow(tidied(run), "shard int, dims int, name string, piece int, data binary"))


def _loaded(pieces: pa.Table, dims: int, degree: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, original vectors, ids, ends of the nodes' ids) from the pieces of a shard."""
    data: dict[str, list[tuple[int, bytes]]] = {}
    for r in pieces.select(["name", "piece", "data"]).to_pylist():
        data.setdefault(r["name"], []).append((r["piece"], r["data"]))
    whole = {name: b"".join(b for _, b in sorted(parts)) for name, parts in data.items()}
    x = np.frombuffer(whole["x"], np.float64).reshape(-1, dims)
    norm = np.square(x).sum(1)
    points = np.concatenate([x.astype(np.float32), np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0))[:, None].astype(np.float32)], 1)
    layers = [np.frombuffer(whole[f"layer{i}"], np.int32).reshape(-1, degree * (1 if i else 2)) for i in range(sum(n.startswith("layer") for n in whole))]
    return Graph(points, layers), x, np.frombuffer(whole["ids"], np.int64), np.frombuffer(whole["ends"], np.int64)


def _named(nodes: np.ndarray, score: np.ndarray, ids: np.ndarray, ends: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of one query's k best rows, never itself: the copies of a node come with their k + 1 smallest ids."""
    begin = np.where(nodes > 0, ends[nodes - 1], 0)
    count = np.minimum(ends[nodes] - begin, k + 1)
    line = np.repeat(np.arange(len(nodes)), count)
    found = ids[begin[line] + np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)]
    value = score[line]
    other = found != own
    found, value = found[other], value[other]
    by = np.lexsort((found, -value))[:k]
    return found[by], value[by]


def nearest(graphs: DataFrame, queries: DataFrame, id_col: str, vec: str, k: int = 20, degree: int = DEGREE, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of each query over the indexed rows but those of its own id.

    Scores are those of the vectors themselves, in double precision; ties go to
    the smaller id; with fewer rows than k, all are given.  Queries without an
    id, or whose vector is null, zero or not finite, have no result; queries meet
    rows of their length.  Rows of one query id that differ are ranked together.
    """
    rows = vectors.kept(queries.filter(F.col(id_col).isNotNull()), vec, _usable(vec)).select(F.col("row")[id_col].cast("long").alias("id"), "x").distinct()
    rows = rows.withColumn("dims", F.size("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list[int]] = {}
        data: dict[int, list[bytes]] = {}
        number = TaskContext.get().partitionId() << 32

        def block(d: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "block": [number], "ids": pa.array([np.array(ids.pop(d), np.int64).tobytes()], pa.binary()), "x": pa.array([b"".join(data.pop(d))], pa.binary())})

        for batch in batches:
            for i, x, d in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.setdefault(d, []).append(i)
                data.setdefault(d, []).append(x.values.to_numpy().tobytes())
                if len(ids[d]) == QUERY_ROWS:
                    yield block(d)
                    number += 1
        for d in list(ids):
            yield block(d)
            number += 1

    blocks = materialise(rows.mapInArrow(packed, "dims int, block long, ids binary, x binary"))
    shards = graphs.select(F.col("shard").alias("to"), F.col("dims").alias("of")).distinct()
    groups = max(1, math.ceil(blocks.count() / QUERY_BLOCKS))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(shards, F.col("dims") == F.col("of")).groupBy("to", "of", "part")
    pieces = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("shard", "dims", "part")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            dims = key[1].as_py()
            graph, x, ids, ends = _loaded(left, dims, degree)
            for r in right.select(["ids", "x"]).to_pylist():
                own, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.float64).reshape(-1, dims)
                # more nodes than asked for, as single precision may confuse close ones
                found = search(graph, q, min(2 * k + 1, len(graph.points)), beam)
                for i, nodes in enumerate(found):
                    nodes = nodes[nodes >= 0].astype(np.int64)
                    a, b = _named(nodes, x[nodes] @ q[i], ids, ends, int(own[i]), k)
                    out.append((np.full(len(a), own[i]), a, b))
        a, b, c = (np.concatenate(v) if out else np.empty(0) for v in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(np.float64))})

    found = pieces.cogroup(dealt).applyInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
