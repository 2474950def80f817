"""Line deduplication by a sharded minimal perfect hash.

Lines are reduced to 128-bit hashes; distinct (line, document) pairs are counted
and lines found in enough documents become the keys of a minimal perfect hash,
built shard by shard on the executors.  Each shard is a few bit arrays with ranks
and, at a key's rank, its fingerprint, document count and keeping document.
Documents then probe those arrays: no line is joined with a line.

A probe needs the arrays in memory, so they are broadcast in rounds of at most
``ROUND_BYTES`` (the size is measured first).  One round probes the documents
directly.  Where more are needed the line hashes are written once, dealt by
round; every round probes its own part and the lines to drop come back to their
documents by doc_id.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.shared import materialise, small_batches, tidied

#: ASCII white space that a key loses at both ends.
STRIP = b" \t\n\x0b\x0c\r"
#: Keys per shard, bytes of arrays that are broadcast at once.
SHARD_KEYS = 1 << 20
ROUND_BYTES = 64 << 20
#: A null doc_id stands below every other one; all null ids are one document.
NULL_ID = -(1 << 63)
_SLICE = 512
_MASK = (1 << 64) - 1


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The 128-bit hash of a line's key as two words, None for keys below ``min_chars`` code points."""
    key = line.strip(STRIP)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    h = xxhash.xxh3_128_intdigest(key.lower())
    return h & _MASK, h >> 64


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mixer (splitmix64 finaliser), another one for each level."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of 64-bit words with the arrays it indexes.

    Each level is a bit array of about twice the keys left; a key alone on its
    bit ends there, others go on.  A key's index is its bit's rank over all
    levels.  Words shared by several keys end in an exact dictionary.
    """

    LEVELS = 40

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray):
        order = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base = 0
        for level in range(self.LEVELS):
            if not len(left):
                break
            size = max(64, 2 * len(left))
            at = (_mix(h1[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((size, words, ranks))
            placed = alone[at]
            order[left[placed]] = self._rank(words, ranks, at[placed])
            base += int(placed.sum())
            left = left[~placed]
        self.rest = {(int(a), int(b)): (int(c), int(d)) for a, b, c, d in zip(h1[left], h2[left], count[left], last[left], strict=True)}
        kept = order >= 0
        self.fingerprint, self.count, self.last = np.empty(base, np.uint64), np.empty(base, np.int64), np.empty(base, np.int64)
        for array, values in ((self.fingerprint, h2), (self.count, count), (self.last, last)):
            array[order[kept]] = values[kept]

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return ranks[word] + np.bitwise_count(below).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's index in the arrays, -1 where the fingerprint differs."""
        out = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(h1[left], level) % np.uint64(size)).astype(np.int64)
            there = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            hit = self._rank(words, ranks, at[there])
            out[left[there]] = np.where(self.fingerprint[hit] == h2[left[there]], hit, -1)
            left = left[~there]
        return out

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, keeping document) of each key."""
        at = self.find(h1, h2)
        found = at >= 0
        last = np.where(found, self.last[at] if len(self.last) else 0, 0)
        if self.rest:
            for i in np.flatnonzero(~found):
                if (x := self.rest.get((int(h1[i]), int(h2[i])))) is not None:
                    found[i], last[i] = True, x[1]
        return found, last


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                ids, a, b = [], [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    found = {line_hash(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
                    ids += [NULL_ID if doc_id is None else doc_id] * len(found)
                    for h1, h2 in found:
                        a.append(_signed(h1))
                        b.append(_signed(h2))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return run


def line_pairs(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc_id) of each distinct line key in each row."""
    return docs.select("doc_id", "text").mapInArrow(tidied(_pairs(min_chars)), "h1 long, h2 long, doc_id long")


def repeated_lines(pairs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of the keys found in at least ``min_docs`` documents.

    The first aggregation makes (key, document) unique, the second sums before
    its shuffle: a line that stands in any share of the documents is no hot spot.
    """
    return (
        pairs.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .filter(F.col("n_docs") >= min_docs)
    )


def build_index(repeated: DataFrame) -> tuple[DataFrame, int]:
    """(shard, size, arrays) rows, written to the shared folder, and the number of shards."""
    repeated = materialise(repeated)
    shards = max(1, math.ceil(repeated.count() / SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        blob = pickle.dumps(PerfectHash(h1, h2, table.column("n_docs").to_numpy(), table.column("last_doc").to_numpy()))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "size": pa.array([len(blob)], pa.int64()), "arrays": pa.array([blob], pa.binary())})

    dealt = repeated.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)).cast("long"))
    return materialise(dealt.groupBy("shard").applyInArrow(build, "shard long, size long, arrays binary")), shards


class _Probe:
    """Looks line hashes up in one round's shards."""

    def __init__(self, arrays, shards: int):
        self.arrays, self.shards, self.tables = arrays, shards, None

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.tables is None:
            self.tables = {k: pickle.loads(v) for k, v in self.arrays.value.items()}
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        shard = np.mod(h2.view(np.int64), self.shards)
        for k in np.unique(shard):
            if (t := self.tables.get(int(k))) is not None:
                own = np.flatnonzero(shard == k)
                found[own], last[own] = t.keeper(h1[own], h2[own])
        return found, last

    def __getstate__(self):
        return {"arrays": self.arrays, "shards": self.shards, "tables": None}


def _rewrite(names: list[str], min_chars: int, drops, n_lines: str, n_dropped: str):
    """Batches with the lines dropped that ``drops(batch, ids, h1, h2)`` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                lines = [(x or b"").split(b"\n") for x in batch.column("text").cast(pa.binary()).to_pylist()]
                rows, places, h1, h2 = [], [], [], []
                for i, own in enumerate(lines):
                    for j, line in enumerate(own):
                        if (h := line_hash(line, min_chars)) is not None:
                            rows.append(i)
                            places.append(j)
                            h1.append(h[0])
                            h2.append(h[1])
                gone: dict[int, set[int]] = {}
                if rows:
                    mark = drops(batch, np.array(rows), np.array(h1, np.uint64), np.array(h2, np.uint64))
                    for k in np.flatnonzero(mark):
                        gone.setdefault(rows[k], set()).add(places[k])
                texts = [b"\n".join(x for j, x in enumerate(own) if j not in gone[i]) if i in gone else b"\n".join(own) for i, own in enumerate(lines)]
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
                columns.append(pa.array([len(x) for x in lines], pa.int64()))
                columns.append(pa.array([len(gone.get(i, ())) for i in range(len(lines))], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*names, n_lines, n_dropped])

    return run


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy()


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, n_lines: str = "n_lines", n_dropped: str = "n_dropped", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and two counts per row.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased.  A key of at least ``min_chars`` code points that stands in at
    least ``min_docs`` documents loses its lines everywhere but in the document
    with the largest doc_id that holds it (there all of them stay).  Null and
    empty texts are one empty line and come back empty.  Rows that share a
    doc_id are one document; null ids are one document below all others.  Other
    columns pass through, but those named like the two counts give way to them;
    an empty table gives an empty result.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n_lines.lower(), n_dropped.lower()}])
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    pairs = line_pairs(docs, min_chars)
    index, shards = build_index(repeated_lines(pairs, min_docs))
    sizes = {r["shard"]: r["size"] for r in index.select("shard", "size").collect()}
    rounds: list[list[int]] = [[]]
    held = 0
    for shard, size in sorted(sizes.items()):
        if held + size > round_bytes and rounds[-1]:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])

    def free(name: str) -> str:
        return name if name not in names else free("_" + name)

    def probe(round_: list[int]) -> _Probe:
        rows = index.filter(F.col("shard").isin(round_)).select("shard", "arrays").collect() if round_ else []
        return _Probe(spark.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in rows}), shards)

    if len(rounds) == 1:
        look = probe(rounds[0])

        def mark(batch, rows, h1, h2):
            found, last = look(h1, h2)
            return found & (last != _ids(batch)[rows])

        return docs.mapInArrow(tidied(_rewrite(names, min_chars, mark, n_lines, n_dropped)), schema)

    of = {s: r for r, own in enumerate(rounds) for s in own}
    round_of = F.element_at(F.array(*[F.lit(of.get(s, 0)) for s in range(shards)]), (F.pmod(F.col("h2"), F.lit(shards)) + 1).cast("int"))
    dealt = materialise(pairs.withColumn("round", round_of).repartition("round", "h1", "doc_id").sortWithinPartitions("round"))

    def marked(look: _Probe):
        def run(batches):
            for b in batches:
                h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
                found, last = look(h1.view(np.uint64), h2.view(np.uint64))
                yield b.filter(pa.array(found & (last != b.column("doc_id").to_numpy())))

        return run

    # one round's arrays at a time: each is probed, its drops are written, and it is released before the next
    drops = None
    for r, own in enumerate(rounds):
        look = probe(own)
        part = materialise(dealt.filter(F.col("round") == r).select("h1", "h2", "doc_id").mapInArrow(tidied(marked(look)), "h1 long, h2 long, doc_id long"))
        look.arrays.unpersist()
        drops = part if drops is None else drops.unionAll(part)
    drops = drops.groupBy(F.col("doc_id").alias(free("_drop_id"))).agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias(free("_drops")))
    joined = docs.join(drops, F.coalesce(F.col("doc_id"), F.lit(NULL_ID)) == F.col(free("_drop_id")), "left").drop(free("_drop_id"))

    def mark_listed(batch, rows, h1, h2):
        listed = [{(x["h1"] & _MASK, x["h2"] & _MASK) for x in own} if own else set() for own in batch.column(free("_drops")).to_pylist()]
        return np.array([(int(a), int(b)) in listed[i] for i, a, b in zip(rows, h1, h2, strict=True)])

    return joined.mapInArrow(tidied(_rewrite(names, min_chars, mark_listed, n_lines, n_dropped)), schema)


def sql() -> str:
    """DuckDB SQL of query op10."""
    return r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, r.key IS NULL OR r.last_doc = k.doc_id AS stays FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE NOT stays))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
