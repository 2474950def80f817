"""Vector code compression: product codes by a Lloyd iteration that is maintained by deltas.

Vectors of whole numbers are cut into consecutive parts, and every part position
has a codebook.  The vectors are written once, in packed blocks and in buckets of
the block number; each round reads them beside the assignments that the round
before has written (in the same buckets, so that no vector is shuffled), assigns
anew, and writes the new assignments with what has changed: for every part that
moved, minus its vector for the entry it left and plus its vector for the entry
it joined, summed by block.  Only these sums are shuffled.  The running sums,
one integer per entry and component, stay with the driver, which moves the
entries.  All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import vectors
from lacuna.llm.shared import bucketed, discard, tidied

#: Vectors of a block; blocks of a bucket.
BLOCK_ROWS = 4096
BUCKET_BLOCKS = 64
MAX_BUCKETS = 50_000
NONE = 255


@dataclass
class Codebooks:
    """``entries[p][e]`` is entry e of part position p, a list of whole numbers; vectors have ``length`` components."""

    entries: list[list[list[int]]]
    factor: float
    length: int
    rounds: int = 0

    @property
    def cuts(self) -> list[int]:
        """Where the parts begin and the last ends; lengths that do not divide are cut as evenly as they can be."""
        return [p * self.length // len(self.entries) for p in range(len(self.entries) + 1)]

    def text(self) -> str:
        return ",".join(str(v) for part in self.entries for entry in part for v in entry)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def assign(x: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row; ties go to the lower index.  Exact."""
    if not x.shape[1] or not len(x):
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    top = max(int(np.abs(x.astype(np.float64)).max()), max(abs(v) for e in entries for v in e)) + 1
    if 4 * x.shape[1] * top * top < 1 << 53:  # whole numbers that doubles hold
        a, c = x.astype(np.float64), np.array(entries, np.float64)
        d = np.square(c).sum(1) - 2 * (a @ c.T)
        at = d.argmin(1)
        return at, (d[np.arange(len(at)), at] + np.square(a).sum(1)).astype(np.int64)
    kind = np.int64 if 4 * x.shape[1] * top * top < 1 << 62 else object
    a, c = x.astype(kind), np.array(entries, kind)
    d = np.stack([np.square(a - e).sum(1) for e in c], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at]


def _packed(width: int, rows: int):
    """Rows of arrays to blocks: their number, the vectors as bytes of the narrowest fitting type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        number = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            x = np.concatenate(held)
            kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or not len(x) or (np.iinfo(k).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(k).max))
            return pa.RecordBatch.from_pydict({"block": [number], "n": pa.array([len(x)], pa.int32()), "size": pa.array([np.dtype(kind).itemsize], pa.int32()), "data": pa.array([x.astype(kind).tobytes()], pa.binary())})

        for batch in batches:
            x = vectors.matrix(batch.column(0), width)
            while len(x):
                take = x[: rows - n]
                held.append(take)
                n, x = n + len(take), x[len(take) :]
                if n == rows:
                    yield block()
                    held, n, number = [], 0, number + 1
        if n:
            yield block()

    return run


def _round(book: Codebooks):
    """Blocks with their old codes to new codes and the sums of what moved."""
    cuts, parts = book.cuts, len(book.entries)

    def moves(x: np.ndarray, old: np.ndarray, new: np.ndarray) -> Iterator[dict]:
        for p in range(parts):
            moved = np.nonzero(old[:, p] != new[:, p])[0]
            if not len(moved):
                continue
            part = x[moved, cuts[p] : cuts[p + 1]]
            for e in range(len(book.entries[p])):
                plus, minus = new[moved, p] == e, old[moved, p] == e
                if plus.any() or minus.any():
                    sums = [a - b for a, b in zip(vectors.exact_sum(part[plus]), vectors.exact_sum(part[minus]), strict=True)]
                    high, low = vectors.limbs([int(plus.sum()) - int(minus.sum()), *sums])
                    yield {"part": p, "entry": e, "high": high, "low": low}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["data"], np.dtype(f"i{row['size']}")).reshape(row["n"], book.length).astype(np.int64)
                old = np.full((row["n"], parts), NONE, np.uint8) if row["codes"] is None else np.frombuffer(row["codes"], np.uint8).reshape(row["n"], parts)
                new = np.stack([assign(x[:, cuts[p] : cuts[p + 1]], book.entries[p])[0] for p in range(parts)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "codes": pa.array([new.tobytes()], pa.binary()), "moves": pa.array([list(moves(x, old, new))], kind)})

    return run


def fit(df: DataFrame, id_col: str, vec: str, parts: int = 8, entries: int = 16, rounds: int = 6, factor: float = 4096.0, block_rows: int = BLOCK_ROWS) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds over all whole vectors; None if there are none.

    Components count as ``floor(factor * c)``.  A codebook starts as that part of
    the vectors with the ``entries`` smallest ids (null ids last, equal ids by
    their vectors); with fewer vectors it has fewer entries.  Vectors that are
    null or hold null or non-finite components take no part, nor do vectors of
    another length than the most frequent one.  An entry that no part is nearest
    to stays as it is.  Stops early once nothing moves, with the same result.
    """
    if not 1 <= entries < NONE:
        raise ValueError(f"entries must be from 1 to {NONE - 1}")
    spark = df.sparkSession
    rows = vectors.kept(df, vec, vectors.whole(F.col(vec), factor))
    usual = vectors.common_length(rows)
    if usual is None:
        return None
    length, n = usual
    rows = rows.filter(F.size("x") == length)
    first = [r["x"] for r in rows.select("x", F.col("row")[id_col].alias("id")).orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()]
    book = Codebooks([], factor, length)
    book.entries = [[] for _ in range(parts)]
    book.entries = [[list(v[a:b]) for v in first] for a, b in zip(book.cuts, book.cuts[1:], strict=False)]
    blocks = math.ceil(n / block_rows)
    buckets = max(1, min(MAX_BUCKETS, blocks, max(math.ceil(blocks / BUCKET_BLOCKS), 2 * spark.sparkContext.defaultParallelism)))
    packed = rows.select("x").mapInArrow(tidied(_packed(length, block_rows)), "block long, n int, size int, data binary")
    base, table = bucketed(packed.repartition(buckets, "block"), "block", buckets)
    counts = [[0] * len(first) for _ in range(parts)]
    sums = [[[0] * (b - a) for _ in first] for a, b in zip(book.cuts, book.cuts[1:], strict=False)]
    last = None
    for _ in range(rounds):
        # assignments of the round before lie in the vectors' buckets
        beside = table.withColumn("codes", F.lit(None).cast("binary")) if last is None else table.join(spark.table(last).select("block", "codes"), "block")
        name, assigned = bucketed(beside.mapInArrow(tidied(_round(book)), "block long, codes binary, moves array<struct<part int, entry int, high array<long>, low array<long>>>"), "block", buckets)
        if last is not None:
            discard(last)
        last = name
        moved = assigned.select(F.inline("moves")).select("part", "entry", F.posexplode(F.arrays_zip("high", "low")).alias("place", "limb"))
        deltas = moved.groupBy("part", "entry", "place").agg(F.sum("limb.high").alias("high"), F.sum("limb.low").alias("low")).collect()  # one row per component of an entry at most
        for r in deltas:
            value = (r["high"] << vectors.LOW) + r["low"]
            if r["place"]:
                sums[r["part"]][r["entry"]][r["place"] - 1] += value
            else:
                counts[r["part"]][r["entry"]] += value
        if not deltas:
            break
        book.rounds += 1
        book = Codebooks([[[s // c for s in t] if c else old for t, c, old in zip(*of, strict=True)] for of in zip(sums, counts, book.entries, strict=True)], factor, length, book.rounds)
    for name in [last, base] if last else [base]:
        discard(name)
    return book


def encode(df: DataFrame, vec: str, book: Codebooks, code: str = "code", error: str = "error") -> DataFrame:
    """The rows whose vector the codebooks fit, with ``code`` (two hex digits per part) and ``error`` (summed squared distances).

    Columns of ``df`` of those names give way.  Errors beyond a long are given as the largest.
    """
    own = [c for c in df.columns if c.lower() not in (code.lower(), error.lower())]
    rows = vectors.kept(df.select(*own), vec, vectors.whole(F.col(vec), book.factor)).filter(F.size("x") == book.length)
    cuts, parts = book.cuts, len(book.entries)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1), book.length)
            found = [assign(x[:, cuts[p] : cuts[p + 1]], book.entries[p]) for p in range(parts)]
            text = np.stack([digits[at] for at, _ in found], 1)
            total = [vectors.as_long(sum(int(d[i]) for _, d in found)) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(t) for t in text], pa.string()), pa.array(total, pa.int64())], names=["row", "_code", "_error"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, _code string, _error long")
    return out.select("row.*", F.col("_code").alias(code), F.col("_error").alias(error))


def decode(df: DataFrame, code: str, book: Codebooks, vec: str = "vector") -> DataFrame:
    """Adds ``vec``, the array<double> that a code stands for; null for a null code or one of another length."""
    parts = len(book.entries)
    at = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    whole = [F.element_at(F.array(*[F.array(*[F.lit((v + 0.5) / book.factor) for v in e]) for e in book.entries[p]]), at[p] + 1) for p in range(parts)]
    return df.withColumn(vec, F.when(F.length(code) == 2 * parts, F.concat(*whole)))


#: More distinct groups than this are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def summed_by(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Adds to each row the sum of ``value`` over the rows of its group; nulls are one group.

    Sums are made before they meet the rows, so a group may hold any share of them.
    """
    sums = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(out))
    if sums.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of query op11."""
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT p.part, p.v, arg_min(b.entry, [list_sum([(p.v[i] - b.c[i]) * (p.v[i] - b.c[i]) for i in range(1, len(p.v) + 1)]), b.entry]) AS entry
  FROM parts p JOIN b{r} b USING (part) GROUP BY p.vec_id, p.part, p.v
), s{r} AS (
  SELECT part, entry, i, (sum(v[i])::HUGEINT - (((sum(v[i])::HUGEINT % count(*)) + count(*)) % count(*))) // count(*) AS c
  FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS i) GROUP BY part, entry, i
), b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c
  FROM b{r} b LEFT JOIN (SELECT part, entry, list(c::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY part, entry) n USING (part, entry)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v
  FROM kept, (SELECT unnest(range({parts})) AS part)
), b0 AS MATERIALIZED (
  SELECT p.part, f.entry, p.v AS c
  FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) f USING (vec_id)
), {", ".join(steps)}, f AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, min([list_sum([(p.v[i] - b.c[i]) * (p.v[i] - b.c[i]) for i in range(1, len(p.v) + 1)])::BIGINT, b.entry]) AS best
  FROM parts p JOIN b{rounds} b USING (part) GROUP BY ALL
), r AS (
  SELECT vec_id, label, string_agg(lpad(to_hex(best[2]), 2, '0'), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM f GROUP BY vec_id, label
)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM r
"""
