"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint is the 64-bit majority of its shingles' hashes.  Equal
fingerprints are one node; nodes at most ``radius`` bits apart are linked.

With radius r the bits are cut into r + 2 blocks, of which two must agree in any
linked pair, so each choice of two blocks is a route: a mask under which the
pair has the same bits.  A route's fingerprints are dealt over the cluster by
these bits.  Each task holds its share of a route in one index: fingerprints are
sorted by Gray rank, the masked bits first, groups of neighbours get the bits
they share as a pattern, groups of groups likewise, so that masked patterns
stand in the upper nodes.  A search goes down adding the differences of each
level's own bits, those under the mask weighing more than the radius, and drops
whole groups once the sum exceeds it.  A pattern under a mask that too many
fingerprints share is dealt once more, by routes over its remaining bits, and
what is then still too many in pairs of blocks.  Links leave a task as a spanning
forest, never as all pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lacuna.llm.components import components
from lacuna.llm.shared import batches_of, bucketed, discard, materialise, small_batches, sweep, tidied

SEED = 42
#: More distinct fingerprints of one pattern under a mask are dealt once more.
NODE_ROWS = 2048
#: About so many rows (fingerprint and route) are dealt to a task.
TASK_ROWS = 400_000
#: Neighbours in Gray order that share a node of the index.
FAN = 16
_CHUNK = 1 << 16
_SLICE = 512


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """Word shingles of the ASCII-lower-cased text, repeats included; the whole sequence if shorter."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(text: bytes | None, size: int) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64; 0 without words."""
    items = shingles(text, size)
    if not items:
        return 0
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, len(items), _CHUNK):
        h = np.array([digest(x, SEED) for x in items[start : start + _CHUNK]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(items), bitorder="little").view(np.uint64)[0])


def _print_batches(names: list[str], size: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                texts = batch.column("text").cast(pa.binary())
                h = np.array([fingerprint(x.as_py(), size) for x in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(h.view(np.int64))], [*names, out])

    return run


def fingerprints(docs: DataFrame, keep: list[str], size: int = 3, out: str = "fp") -> DataFrame:
    """The columns ``keep`` of each row and its fingerprint as a (signed) long."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.LongType())])
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    return source.mapInArrow(tidied(_print_batches(keep, size, out)), schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the Gray code sequence."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _arranged(fps: np.ndarray, mask: int) -> np.ndarray:
    """The fingerprints with the bits under ``mask`` moved to the top, in their order."""
    bits = [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    out = np.zeros_like(fps)
    start = 0
    while start < 64:  # runs of neighbouring bits move together
        end = start + 1
        while end < 64 and bits[end] == bits[end - 1] - 1:
            end += 1
        run = (fps >> np.uint64(bits[end - 1])) & np.uint64((1 << (end - start)) - 1)
        out |= run << np.uint64(64 - end)
        start = end
    return out


class GrayIndex:
    """Hierarchical index over distinct fingerprints in Gray order, the bits under ``mask`` first.

    A search finds what is at most a radius apart and equal under the mask.
    ``looked`` and ``dropped`` count the groups that searches have compared and pruned.
    """

    def __init__(self, fps: np.ndarray, mask: int = 0):
        self.top = np.uint64((1 << mask.bit_count()) - 1 << 64 - mask.bit_count())
        self.own = _arranged(fps, mask)
        self.order = np.argsort(gray_rank(self.own), kind="stable")
        self.fps = self.own[self.order]
        self.looked = self.dropped = 0
        ones, any_ = self.fps, self.fps
        levels = []
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FAN)
            ones, any_ = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts)
            levels.append((ones, ~(ones ^ any_)))
        self.levels = []
        above = None
        for pattern, shared in reversed(levels):
            own = shared if above is None else shared & ~np.repeat(above, FAN)[: len(shared)]
            self.levels.append((pattern, own))
            above = shared
        self.leaf = np.full(len(fps), ~np.uint64(0)) if above is None else ~np.repeat(above, FAN)[: len(fps)]

    def pairs(self, radius: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of fingerprints at most ``radius`` bits apart and equal under the mask, block by block."""
        sizes = [len(p) for p, _ in self.levels] + [len(self.fps)]
        for start in range(0, len(self.fps), block):
            q = np.arange(start, min(start + block, len(self.fps)))
            node, gap = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for level, (pattern, own) in enumerate([*self.levels, (self.fps, self.leaf)]):
                if level:
                    q, gap = np.repeat(q, FAN), np.repeat(gap, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = node < sizes[level]
                    q, gap, node = q[there], gap[there], node[there]
                differ = (self.fps[q] ^ pattern[node]) & own[node]
                gap = gap + np.bitwise_count(differ) + (radius + 1) * ((differ & self.top) != 0)
                near = gap <= radius
                if level < len(self.levels):
                    self.looked += len(near)
                    self.dropped += len(near) - int(near.sum())
                q, gap, node = q[near], gap[near], node[near]
            a, b = self.order[q], self.order[node]
            yield a[a < b], b[a < b]


def forest(index: GrayIndex, radius: int) -> list[tuple[int, int]]:
    """Links (position, position) that join exactly what the pairs of the index join."""
    parent = list(range(len(index.fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in index.pairs(radius):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                parent[x] = y
                out.append((i, j))
    return out


def _blocks(free: list[int], count: int) -> list[int]:
    """The bits ``free`` cut into ``count`` masks."""
    cuts = [round(i * len(free) / count) for i in range(count + 1)]
    return [sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _masks(radius: int) -> list[tuple[int, list[int]]]:
    """The masks of the routes, each with those that split its remaining bits."""
    out = []
    for pair in combinations(_blocks(list(range(64)), radius + 2), 2):
        mask = pair[0] | pair[1]
        free = [b for b in range(64) if not mask >> b & 1]
        out.append((mask, [mask | x | y for x, y in combinations(_blocks(free, radius + 2), 2)]))
    return out


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _linker(radius: int, masks: list[int]):
    """Streams the rows (route, fp) of a task, sorted by route; yields the links that each route's index finds."""

    def links(route: int, fp: np.ndarray) -> pa.RecordBatch:
        fp = np.unique(fp)
        found = np.array(forest(GrayIndex(fp, masks[route]), radius), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[found[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            route, fp = batch.column("route").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(route)) + 1).tolist(), len(route)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s and route[s] != now:
                    if held:
                        yield links(now, np.concatenate(held))
                    now, held = int(route[s]), []
                if e > s:
                    held.append(fp[s:e])
        if held:
            yield links(now, np.concatenate(held))

    return run


def _crowded(rows: DataFrame) -> DataFrame:
    """(_route, _key, n) of the patterns that more than ``NODE_ROWS`` fingerprints share."""
    counts = rows.groupBy(F.col("route").alias("_route"), F.col("key").alias("_key")).agg(F.count("*").alias("n"))
    return materialise(counts.filter(F.col("n") > NODE_ROWS))


def _routes(rows: DataFrame, crowded: DataFrame, left: str) -> DataFrame:
    return rows.join(crowded, (F.col("route") == F.col("_route")) & (F.col("key") == F.col("_key")), left)


def link_fingerprints(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most ``radius`` bits apart, as the tasks' forests."""
    spark = distinct.sparkSession
    masks = _masks(radius)
    every = [m for m, _ in masks] + [m for _, parts in masks for m in parts]
    keyed = lambda numbers: F.array(*[F.struct(F.lit(i).alias("route"), F.col("fp").bitwiseAND(_long(every[i])).alias("key")) for i in numbers])
    rows = distinct.select("fp", F.explode(keyed(range(len(masks)))).alias("t")).select("fp", "t.route", "t.key")
    crowded = _crowded(rows)
    block = F.lit(0).cast("long")
    dealt = rows.withColumn("block", block)
    if not crowded.isEmpty():
        dealt = _routes(rows, crowded, "left_anti").withColumn("block", block)
        split = F.lit(None)
        width = len(masks[0][1])
        for i in range(len(masks)):
            split = F.when(F.col("route") == i, keyed(range(len(masks) + i * width, len(masks) + (i + 1) * width))).otherwise(split)
        deep = materialise(_routes(rows, crowded, "left_semi").select("fp", F.explode(split).alias("t")).select("fp", "t.route", "t.key").distinct())
        packed = _crowded(deep)
        dealt = dealt.unionAll(_routes(deep, packed, "left_anti").withColumn("block", block))
        mine = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / NODE_ROWS))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / NODE_ROWS) - 1))
        blocks = _routes(deep, packed, "inner").withColumn("mine", mine).withColumn("other", other)
        pair = F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other"))
        dealt = dealt.unionAll(blocks.select("fp", "route", "key", pair.alias("block")))
    # each share is a bounded part of the rows, however many there are
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(distinct.count() * len(masks) / TASK_ROWS))
    shares = dealt.repartition(parts, "route", "key", "block").select("route", "fp").sortWithinPartitions("route")
    return shares.mapInArrow(_linker(radius, every), "a long, b long")


def _groups(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least doc_id, root fp) of each distinct fingerprint of (doc_id, fp) rows."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_fingerprints(distinct, radius), "a", "b")
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the least doc_id reachable over links, the row's own
    included.  Null and empty texts have fingerprint 0 and link like others;
    equal rows are linked; a null doc_id never names a component unless all ids
    of its component are null.  Other columns are ignored; an empty table gives
    an empty result.
    """
    prints = materialise(fingerprints(docs, ["doc_id"], size))
    groups = materialise(_groups(prints, radius))
    names = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(names, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, size)], np.uint64))


def prefix(hashes: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that any two sets of at least ``similarity`` share one of theirs.

    The order is total, by (count, hash).
    """
    n = len(hashes)
    if not n:
        return hashes
    return hashes[np.lexsort((hashes, counts))][: n - math.ceil(similarity * n - 1e-6) + 1]


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes: a bit is 1 if set in over half of them."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _sketches(size: int):
    """Of each text a name of its words and the fingerprint of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                w = [xxhash.xxh3_128_digest(b" ".join((x or b"").lower().split())) for x in texts]
                sets = [shingle_set(x, size) for x in texts]
                columns = [batch.column("doc_id"), pa.array(w, pa.binary()), pa.array([_majority(x) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "w", "fp"])

    return run


def _alike(size: int, similarity: float):
    """Of rows (a, b, ta, tb) those ids whose texts' shingle sets have at least the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, frozenset()
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary()), strict=True):
                x, y = ta.as_py() or b"", tb.as_py() or b""
                if x != last:
                    last, mine = x, frozenset(shingles(x, size))
                theirs = frozenset(shingles(y, size))
                common = len(mine & theirs)
                keep.append(common >= similarity * (len(mine) + len(theirs) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bits that linked fingerprints differ in at most, in the first pass.
DEDUP_RADIUS = 3
#: Fingerprints of sets of at least so many shingles and a Jaccard coefficient of 0.8 differ in 9.7 of 64 bits on
#: average (standard deviation 2.9), those of unlike sets in 32 (4): more than FAR bits apart is 4.9 deviations off.
SMALL_SET = 32
FAR = 24
#: Texts that a shingle's list compares to the rest of it at once, in the first round and later.
HEADS = (8, 64)


#: Lists of at most so many ids, or pairs of ids, are broadcast.
BROADCAST_IDS = 1_000_000
#: Likewise of shingles, one number each (about 150 MB as a hash table).
BROADCAST_SHINGLES = 4_000_000


def _listed(df: DataFrame, column: str, ids: DataFrame, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """``df`` joined on ``column`` to the first column of ``ids``, broadcast if its counted size allows."""
    ids = ids.withColumnRenamed(ids.columns[0], "_listed")
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, F.col(column) == F.col("_listed"), how)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are that similar; only the texts of pairs move."""
    pairs = materialise(pairs)
    texts = docs.select("doc_id", "text")
    b = _listed(texts.withColumnRenamed("text", "tb"), "doc_id", pairs.select("b", "a"), "inner").select("a", F.col("doc_id").alias("b"), "tb")
    a = _listed(texts.withColumnRenamed("text", "ta"), "doc_id", pairs.select("a").distinct(), "left_semi").select(F.col("doc_id").alias("_a"), "ta")
    both = b.join(a, F.col("a") == F.col("_a")).select("a", "b", "ta", "tb")
    return materialise(both.mapInArrow(tidied(_alike(size, similarity)), T.StructType([both.schema["a"], both.schema["b"]])))


def _met(posts: DataFrame, heads: DataFrame, similarity: float, far: int) -> DataFrame:
    """Pairs (a, b), a < b, of a head of a list and a text of the list that could be so similar if this shingle is their first.

    Their sets then share at most what stands from their places on, and must
    share the part of their sizes that the similarity asks for; and their
    fingerprints differ in at most ``far`` bits, unless a set is small.
    """
    a = heads.select("x", F.col("id").alias("a"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("fp").alias("other"))
    most = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    met = posts.join(a, "x").filter(F.col("a") < F.col("id"))
    met = met.filter((F.least("n", "m") < SMALL_SET) | (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= far))
    return met.filter(most + 1e-6 >= similarity / (1 + similarity) * (F.col("n") + F.col("m"))).select("a", F.col("id").alias("b")).distinct()


def _minus(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias("_minus")), F.col(column) == F.col("_minus"), "left_anti")


#: Hashes of the texts whose shingles are counted together first (a chunk); of a range, which one task counts; of a bucket of chunks; and ranges at most.
CHUNK_HASHES = 1 << 17
RANGE_HASHES = 1_000_000
BUCKET_HASHES = 4_000_000
MAX_RANGES = 1 << 16
#: Bytes of an Arrow batch of chunks, each about a megabyte.
CHUNK_BATCH = 2 << 20
#: A range's hashes travel as so many bytes each; what stands below them does not (two hashes may then seem one, which only costs work).
PACKED_BYTES = 5
#: Counts that reach so far are not told apart; they order shingles that are none of the rare ones.
MOST = 255


def _chunked(size: int):
    """The shingle sets of a task's texts, some ``CHUNK_HASHES`` hashes to a row, text after text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        ids, sets, held = [], [], 0

        def row() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            columns = [pa.array([made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([[len(x) for x in sets]], pa.list_(pa.int32())), pa.array([[_majority(x) for x in sets]], pa.list_(pa.int64())), pa.array([np.concatenate(sets).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "n", "fp", "hashes"])

        for batch in batches:
            begun = 0
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                sets.append(shingle_set(text.as_py(), size))
                held += len(sets[-1])
                if held >= CHUNK_HASHES:
                    ids.append(batch.column("doc_id").slice(begun, i + 1 - begun))
                    yield row()
                    made, ids, sets, held, begun = made + 1, [], [], 0, i + 1
            if begun < batch.num_rows:
                ids.append(batch.column("doc_id").slice(begun))
        if sets:
            yield row()

    return run


def _dealt(bits: int):
    """A chunk's distinct hashes by their ``bits`` highest bits, the others packed, with how often the chunk has each: (range, chunk, hashes, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk"), batch.column("hashes"), strict=True):
                x, times = np.unique(np.frombuffer(blob.as_py(), np.uint64), return_counts=True)
                if not len(x):
                    continue
                top = (x >> np.uint64(64 - bits)).astype(np.int64)
                low = np.ascontiguousarray(((x << np.uint64(bits)) >> np.uint64(64 - 8 * PACKED_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED_BYTES])
                cuts = np.flatnonzero(np.diff(top)) + 1
                first = np.concatenate([[0], cuts])
                times = np.minimum(times, MOST).astype(np.uint8)
                columns = [pa.array(top[first], pa.int64()), pa.array([chunk.as_py()] * len(first), pa.int64()), pa.array([v.tobytes() for v in np.split(low, cuts)], pa.binary()), pa.array([zlib.compress(v.tobytes(), 1) for v in np.split(times, cuts)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "chunk", "hashes", "counts"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """A range's rows with the counts over all chunks in place of their own, in the same order."""
    rows = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, PACKED_BYTES) for x in table.column("hashes")]
    times = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in table.column("counts")])
    whole = np.zeros((len(times), 8), np.uint8)
    whole[:, :PACKED_BYTES] = np.concatenate(rows)
    _, at = np.unique(whole.reshape(-1).view("<u8"), return_inverse=True)
    total = np.minimum(np.bincount(at, weights=times), MOST).astype(np.uint8)[at]
    parts = np.split(total, np.cumsum([len(x) for x in rows])[:-1])
    return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "counts": pa.array([zlib.compress(v.tobytes(), 1) for v in parts], pa.binary())})


def _first(similarity: float):
    """Of chunks with the counts of their hashes (by range) the prefix of each text, without the shingles that no other text has: (id, n, fp, pos, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, prints, blob, counts = (batch.column(c)[k] for c in ("ids", "n", "fp", "hashes", "counts"))
                hashes = np.frombuffer(blob.as_py(), np.uint64)
                of = np.concatenate([np.frombuffer(zlib.decompress(c["counts"].as_py()), np.uint8) for c in counts])
                own = of[np.unique(hashes, return_inverse=True)[1]]
                sizes, stop = np.array(sizes.as_py()), np.cumsum(sizes.as_py())
                at, pos, x = [], [], []
                for i, (b, n) in enumerate(zip(stop, sizes, strict=True)):
                    mine, seen = hashes[b - n : b], own[b - n : b]
                    rare = prefix(mine, similarity, seen)
                    places = np.flatnonzero(seen[np.searchsorted(mine, rare)] > 1)
                    at.append(np.full(len(places), i))
                    pos.append(places)
                    x.append(rare[places].view(np.int64))
                at = np.concatenate(at)
                columns = [ids.values.take(pa.array(at, pa.int64())), pa.array(sizes[at], pa.int32()), prints.values.take(pa.array(at, pa.int64())), pa.array(np.concatenate(pos), pa.int32()), pa.array(np.concatenate(x), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "fp", "pos", "x"])

    return run


def postings(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, n, fp, pos, x): the shingles of each text's prefix that another text has too; n and fp are the set's size and fingerprint.

    A text's prefix are its rarest shingles, by their exact count over all texts
    (beyond ``MOST`` by hash).  The sets are written once in chunks; a chunk's
    distinct hashes are dealt by range, five bytes each, counted there, and the
    counts, mostly ones and so nothing when packed, come back to the chunks, which
    lie in buckets and do not move: the counts are dealt into as many parts by the
    same key.  Nothing grows with the corpus but the number of chunks and ranges,
    and a shingle that all texts have is one number a chunk.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.select(F.sum(F.length("text"))).first()[0] or 0  # about six characters a word, and a shingle a word
    ranges, buckets = (max(1, math.ceil(total / 6 / part)) for part in (RANGE_HASHES, BUCKET_HASHES))
    bits = min(MAX_RANGES, max(16, ranges)).bit_length()
    name, chunks = bucketed(docs.select("doc_id", "text").mapInArrow(tidied(_chunked(size)), f"chunk long, ids array<{kind}>, n array<int>, fp array<long>, hashes binary"), "chunk", buckets)
    dealt = chunks.select("chunk", "hashes").mapInArrow(tidied(_dealt(bits)), "range long, chunk long, hashes binary, counts binary")
    counted = dealt.groupBy("range").applyInArrow(_counted, "chunk long, range long, counts binary")
    # dealt into the buckets: where the shuffle has more partitions than there are buckets, the join would shuffle the chunks to match it
    answers = counted.repartition(buckets, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "counts"))).alias("counts"))
    answers = answers.select("chunk", F.transform("counts", lambda c: F.struct(c["counts"].alias("counts"))).alias("counts"))
    with batches_of(docs.sparkSession, CHUNK_BATCH):
        found = materialise(chunks.join(answers.hint("shuffle_hash"), "chunk").mapInArrow(tidied(_first(similarity)), f"id {kind}, n int, fp long, pos int, x long"))
    discard(name)
    return found


def _shared(posts: DataFrame) -> DataFrame:
    """The rows of lists with two texts or more."""
    several = materialise(posts.groupBy("x").agg(F.count("*").alias("_n")).filter("_n > 1").select("x"))
    sweep(posts.sparkSession)
    return materialise(_listed(posts, "x", several, "left_semi", BROADCAST_SHINGLES))


def duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, far: int = FAR) -> DataFrame:
    """The doc_ids that go if one document of each group of near-duplicates stays.

    Texts of the same words (ASCII-lower-cased) are copies: the least doc_id
    stands for them.  Two passes follow over the distinct texts, in each of which
    a text goes if its shingle set has a Jaccard coefficient of at least
    ``similarity`` with a lesser one.

    The first pass compares each text to the least of those that its SimHash
    reaches over links of ``DEDUP_RADIUS`` bits.  SimHash cannot reach most pairs
    near the similarity, so the second finds what is left (all pairs but those
    whose fingerprints are implausibly far apart, see ``FAR``; with ``far`` 64
    all pairs without exception): in the order of
    ids, a text goes if it is that similar to one that stays.  Two such sets
    share one of their rarest shingles (``prefix``).  In each shingle's list the
    least texts are compared to all others; a text that is among the least in
    all its lists has met every lesser text it could resemble, so it stays
    unless one that stays resembles it.  What is left makes shorter lists for
    the next round.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    prints = materialise(docs.mapInArrow(tidied(_sketches(size)), f"doc_id {kind}, w binary, fp long"))
    texts = materialise(prints.groupBy("w").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")))
    copies = prints.select("doc_id", F.col("w").alias("_w")).join(texts.select("w", "least"), (F.col("w") == F.col("_w")) & (F.col("doc_id") != F.col("least")))
    gone = [materialise(copies.select("doc_id"))]

    groups = materialise(_groups(texts.select(F.col("least").alias("doc_id"), "fp"), DEDUP_RADIUS))
    heads = groups.groupBy("root").agg(F.min("least").alias("a"))
    linked = texts.select("fp", F.col("least").alias("b")).join(groups.select(F.col("fp").alias("_fp"), "root"), F.col("fp") == F.col("_fp")).join(heads, "root")
    near = _verified(linked.filter("a < b").select("a", "b"), docs, size, similarity)
    gone.append(near.select(F.col("b").alias("doc_id")))

    sweep(docs.sparkSession)

    left = materialise(_minus(texts.select(F.col("least").alias("id")), "id", gone[1]))
    posts = postings(_listed(docs, "doc_id", left, "left_semi"), size, similarity)
    sweep(docs.sparkSession)
    # lists mostly hold copies of their least text: where that leads all its own lists it stays, and what resembles it goes
    least = posts.groupBy(F.col("x").alias("_x")).agg(F.min("id").alias("a"))
    heads = materialise(posts.join(least, (F.col("x") == F.col("_x")) & (F.col("id") == F.col("a")), "left_semi"))
    leading = heads.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("met"))
    listed = posts.groupBy("id").agg(F.count("*").alias("all"))
    sure = listed.join(leading, F.col("id") == F.col("_id")).filter(F.col("all") == F.col("met")).select(F.col("id").alias("_a"))
    quick = _met(posts, heads, similarity, far).join(sure, F.col("a") == F.col("_a"), "left_semi").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    gone.append(_verified(quick, docs, size, similarity).select(F.col("b").alias("doc_id")))
    posts = _shared(_minus(posts, "id", gone[2]))
    for turn in count():
        if posts.isEmpty():
            break
        rank = F.row_number().over(W.partitionBy("x").orderBy("id"))
        heads = materialise(posts.withColumn("rank", rank).filter(F.col("rank") <= HEADS[min(turn, 1)]).drop("rank"))
        near = _verified(_met(posts, heads, similarity, far), docs, size, similarity)
        listed = posts.groupBy("id").agg(F.count("*").alias("all"))
        leading = heads.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("met"))
        unsure = materialise(listed.join(leading, F.col("id") == F.col("_id"), "left").filter("all > coalesce(met, 0)").select("id"))
        while True:
            stay = _minus(_minus(near.select("a").distinct(), "a", near.select("b")), "a", unsure)
            went = materialise(near.join(stay.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"), "left_semi").select(F.col("b").alias("doc_id")).distinct())
            if went.isEmpty():
                break
            gone.append(went)
            near = materialise(_minus(_minus(near, "a", went), "b", went))
            unsure = _minus(unsure, "id", went)
        left = unsure.unionAll(near.select(F.col("b").alias("id"))).distinct().withColumnRenamed("id", "_id")
        posts = _shared(posts.join(left, F.col("id") == F.col("_id"), "left_semi"))
    return materialise(reduce(DataFrame.unionAll, gone).distinct())


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of the given ids."""
    return _listed(docs, "doc_id", ids, "left_anti")


def dedup_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8, far: int = FAR) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates (see ``duplicates``).

    A document is a doc_id with a text: equal texts under one doc_id are one row
    (the least by all its columns), other texts under it are documents of their
    own, so that no text is lost with a copy beside it.  Rows without a doc_id
    stay as they are.  Null and empty texts are copies of each other.  Further
    columns pass through; an empty table gives an empty result.
    """
    again = materialise(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return _without(docs, duplicates(docs, size, similarity, far))
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    listed = again.select(F.col("doc_id").alias("_again"))
    several = docs.join(listed, F.col("doc_id") == F.col("_again"), "left_semi").groupBy(key.alias("key")).agg(F.min(F.struct(*docs.columns)).alias("own"))
    single = _without(docs.filter("doc_id IS NOT NULL"), again).select(key.alias("key"), F.struct(*docs.columns).alias("own"))
    rows = materialise(single.unionByName(several))
    gone = duplicates(rows.select(F.col("key").alias("doc_id"), "own.text"), size, similarity, far)
    return _listed(rows, "key", gone, "left_anti").select("own.*").unionByName(docs.filter("doc_id IS NULL"))
