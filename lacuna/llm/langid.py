"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, at most ``ORDER``, over
all 256 byte values, with frozen statistics and escape method C: in a context
seen n times with d different bytes, a byte seen c times costs
``-log2(c / (n + d))`` bits and the escape to the next shorter context
``-log2(d / (n + d))``; a context never seen is left at no cost; below order 0
all bytes are equally likely.  A text's exact code length is the sum over its
bytes, and the language with the shortest code is predicted.

The statistics never change while scoring, so each order is laid out as two hash
tables: the cost of every (context, byte) seen in any language, escapes
included, and the escape of every context.  A text's bytes are looked up at the
highest order, those not found there one order lower, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.shared import small_batches, tidied

#: At most about so many documents of each language are counted.
FIT_DOCS = 400
#: Bytes of the longest context; a context and its byte must fit a 64-bit number.
ORDER = 4
UNDETERMINED = "und"
_CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _padded(texts: list[bytes], order: int) -> np.ndarray:
    """The texts end to end, each after ``order`` blanks."""
    return np.frombuffer(b"".join(b" " * order + t for t in texts), np.uint8)


def _grams(x: np.ndarray, size: int) -> np.ndarray:
    """Every run of ``size`` bytes as one number, the first byte highest."""
    n = max(0, len(x) - size + 1)
    out = np.zeros(n, np.int64)
    for k in range(size):
        out <<= 8
        out |= x[k : k + n]
    return out


class Table:
    """A hash table from distinct numbers to their positions, looked up many at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slot_key, self.slot_row = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        open_ = np.arange(len(keys))
        at = self._slot(keys)
        while len(open_):
            free = self.slot_row[at[open_]] < 0
            tried = open_[free]
            self.slot_row[at[tried]] = tried  # of several that want a slot the last has it
            won = self.slot_row[at[open_]] == open_
            self.slot_key[at[open_[won]]] = keys[open_[won]]
            open_ = open_[~won]
            at[open_] = (at[open_] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for others."""
        at = self._slot(keys)
        out = self.slot_row[at]
        open_ = np.flatnonzero((out >= 0) & (self.slot_key[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slot_row) - 1)
            out[open_] = self.slot_row[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.slot_key[at[open_]] != keys[open_])]
        return out


def count_grams(labelled: DataFrame, label: str, fit_docs: int = FIT_DOCS, order: int = ORDER) -> list[tuple[str, int, int]]:
    """(language, context and byte, count) over at most about ``fit_docs`` whole texts of each language.

    Where a language has more, the rows whose hash is below a threshold count.
    """
    rows = labelled.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).cast("string").alias("label"), "text", F.xxhash64("doc_id").alias("h"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    space = 1 << 30
    limit = F.lit(0)
    for name, n in sorted(sizes.items()):
        limit = F.when(F.col("label") == name, F.lit(int(space * min(1.0, fit_docs / n)))).otherwise(limit)
    sample = rows.filter(F.pmod(F.col("h"), F.lit(space)) < limit).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("label").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                grams, counts = np.unique(_grams(_padded([text], order), order + 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["label", "gram", "n"])

    counted = sample.mapInArrow(run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    return [(r["label"], r["gram"], r["n"]) for r in counted.collect()]


class Trees:
    """The context trees of all languages as cost tables."""

    def __init__(self, counts: list[tuple[str, int, int]], order: int = ORDER):
        self.languages, self.order = sorted({c[0] for c in counts}), order
        grams = np.array([c[1] for c in counts], np.int64)
        n = np.array([c[2] for c in counts], np.float64)
        lang = np.searchsorted(self.languages, [c[0] for c in counts]) if counts else np.empty(0, np.int64)
        width = len(self.languages)
        #: by order: the (context, byte) pairs and the contexts seen in any language, with a cost for each language.
        self.pairs: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.tables: list[tuple[Table, Table]] | None = None
        for k in range(order + 1):
            pairs, at = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.zeros((len(pairs), width))
            np.add.at(seen, (at, lang), n)
            contexts, of = np.unique(pairs >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(seen / (total + distinct)[of])
            shorter = self._shorter(pairs, k) if k else np.full((len(pairs), width), 8.0)
            self.costs.append(np.where(seen > 0, own, escape[of] + shorter).astype(np.float32))
            self.pairs.append(pairs)
            self.contexts.append(contexts)
            self.escapes.append(escape.astype(np.float32))

    def _shorter(self, pairs: np.ndarray, k: int) -> np.ndarray:
        """The costs of pairs of order k one order lower, where all their endings were seen too."""
        return self.costs[k - 1][np.searchsorted(self.pairs[k - 1], pairs & ((1 << 8 * k) - 1))]

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text (row) under each language (column)."""
        if self.tables is None:
            self.tables = [(Table(p), Table(c)) for p, c in zip(self.pairs, self.contexts, strict=True)]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + self.order)
        key = _grams(_padded(texts, self.order), self.order + 1)
        cost = np.zeros((len(key), len(self.languages)))
        left = np.arange(len(key))
        for k in range(self.order, -1, -1):
            own = key[left] & ((1 << 8 * (k + 1)) - 1)
            pairs, contexts = self.tables[k]
            row = pairs.rows(own)
            found = row >= 0
            cost[left[found]] += self.costs[k][row[found]]
            left, own = left[~found], own[~found]
            at = contexts.rows(own >> 8)
            cost[left[at >= 0]] += self.escapes[k][at[at >= 0]]
        cost[left] += 8.0
        run = np.zeros((len(key) + 1, len(self.languages)))
        np.cumsum(cost, axis=0, out=run[1:])
        return run[ends - self.order] - run[ends - self.order - sizes]


def _predict(trees, keep: list[str], pred: str, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trees = trees.value
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            names: list[str] = []
            scores: list[float] = []
            group: list[bytes] = []
            held = 0
            for i, text in enumerate(texts):
                group.append(text)
                held += len(text)
                if held < _CHUNK and i + 1 < len(texts):
                    continue
                bits = model.bits(group) if model.languages else np.zeros((len(group), 0))
                for own, row in zip(group, bits, strict=True):
                    if not len(row) or not _LETTER.search(own.decode("utf-8", "replace")):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        best = int(row.argmin())
                        names.append(model.languages[best])
                        scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
                group, held = [], 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, pred, score])

    return run


def fit(labelled: DataFrame, label: str = "lang", fit_docs: int = FIT_DOCS, order: int = ORDER) -> Trees:
    """Trees from rows (doc_id, text, label); null texts and labels teach nothing."""
    return Trees(count_grams(labelled, label, fit_docs, order), order)


def identify(docs: DataFrame, trees: Trees, keep: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` of each row, the predicted language and its posterior at equal odds.

    Texts that are null or hold no letter are ``und`` with score 0, as is
    everything if no language was learned; equal texts get equal answers; ties
    go to the first language in code-point order; very long texts are coded as
    wholes; an empty table gives an empty result.  Of ``keep``, columns named like
    the results give way to them.
    """
    keep = [c for c in keep if c.lower() not in {pred.lower(), score.lower()}]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidied(_predict(shared, keep, pred, score)), schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
