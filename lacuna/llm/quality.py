"""Quality rules as a short-circuit cascade.

Each rule needs some groups of metrics of a text.  On a sample every rule is run
alone to estimate its cost (seconds per document, without the groups that are
wanted of every text anyhow) and its selectivity (share of
documents it rejects); the cascade then asks the rules in order of rejection per
cost, and computes a group of metrics only for the documents still standing.
The order changes what is computed, never whether a text is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLICE = 256
WINDOW = 8
#: At most about so many documents are timed for the order of the rules.
SAMPLE_ROWS = 2000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])


def _per_text(texts: list[bytes]):
    """The texts' bytes, blanks between them, and a function that sums marks of bytes by text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes + 1)

    def per_text(mark: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return run[ends] - run[ends - sizes - 1]

    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), per_text


def count_metrics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars and n_symbols of each text."""
    data, per_text = _per_text(texts)
    space = _SPACE[data]
    head = ~space & np.concatenate([[True], space[:-1]])
    return {"n_words": per_text(head), "word_chars": per_text(_HEAD[data] & ~space), "n_symbols": per_text(_SYMBOL[data])}


def case_metrics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_upper (A-Z) and n_letters (A-Z, a-z) of each text."""
    data, per_text = _per_text(texts)
    return {"n_upper": per_text(_UPPER[data]), "n_letters": per_text(_LETTER[data])}


def stutter_metrics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_stutters: words equal to the one before."""
    found = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        found[i] = sum(map(eq, words, islice(words, 1, None)))
    return {"n_stutters": found}


def line_metrics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_lines with a word, and n_dup_lines: those equal to an earlier line."""
    n, dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        n[i] = len(lines)
        dup[i] = len(lines) - len(set(lines))
    return {"n_lines": n, "n_dup_lines": dup}


class _Ids(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def repeat_metrics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_repeat_words: words in windows of ``WINDOW`` words that stand twice or more in the text.

    Windows are named exactly, by doubling: names of pairs of words, then pairs
    of those, then pairs of those within a document.
    """
    words = [x.split() for x in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(texts), np.int64)
    found = {"n_repeat_words": out}
    ids = _Ids()
    name = np.fromiter((ids[w] for own in words for w in own), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if total < WINDOW:
        return found
    step = 1
    while 2 * step < WINDOW:
        both = name[:-step] * (int(name.max()) + 1) + name[step:]
        name = np.unique(both, return_inverse=True)[1]
        step *= 2
    both = name[:-step] * (int(name.max()) + 1) + name[step:]
    inside = doc[: len(both)] == doc[WINDOW - 1 :][: len(both)]
    at = np.flatnonzero(inside)
    if not len(at):
        return found
    name = np.unique(both[at], return_inverse=True)[1]
    _, inverse, count = np.unique(name * len(texts) + doc[at], return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    np.add.at(out, doc[np.cumsum(cover[:-1]) > 0], 1)
    return found


GROUPS: dict[str, Callable[[list[bytes]], dict[str, np.ndarray]]] = {
    "counts": count_metrics,
    "case": case_metrics,
    "stutters": stutter_metrics,
    "lines": line_metrics,
    "repeats": repeat_metrics,
}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects(metrics)`` is true; needs the metrics of ``groups``."""

    name: str
    groups: tuple[str, ...]
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


#: The rules every text must pass whatever the cascade.
BASE_RULES = (
    Rule("few_words", ("counts",), lambda m: m["n_words"] < 20),
    Rule("repeated_words", ("counts", "repeats"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("counts",), lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("long_words", ("counts",), lambda m: m["word_chars"] > 25 * m["n_words"]),
    Rule("short_words", ("counts",), lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("shouting", ("case",), lambda m: 2 * m["n_upper"] > m["n_letters"]),
    Rule("stutters", ("counts", "stutters"), lambda m: 10 * m["n_stutters"] > 3 * m["n_words"]),
    Rule("repeated_lines", ("lines",), lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def estimate(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected) on a sample of at most about ``sample_rows`` texts.

    The sample is the rows whose text's hash is below a threshold.  Groups of
    metrics ``given`` for every text anyhow are no cost of a rule.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(1, total))
    space = 1 << 30
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(space)) < int(space * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, spent, gone = 0, [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                texts = _texts(batch.slice(start, _SLICE))
                n += len(texts)
                known: dict[str, np.ndarray] = {}
                for g in given:
                    known |= GROUPS[g](texts)
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    metrics = dict(known)
                    for g in rule.groups:
                        if g not in given:
                            metrics |= GROUPS[g](texts)
                    gone[i] += int(rule.rejects(metrics).sum())
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "n": [n] * len(rules), "spent": spent, "gone": gone})

    rows = sample.mapInArrow(run, "rule long, n long, spent double, gone long").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("spent").alias("spent"), F.sum("gone").alias("gone"))
    found = {r["rule"]: r for r in rows.collect()}
    return [(rule.name, found[i]["spent"] / max(1, found[i]["n"]) if i in found else 0.0, found[i]["gone"] / max(1, found[i]["n"]) if i in found else 0.0) for i, rule in enumerate(rules)]


def order(rules, estimates: list[tuple[str, float, float]]) -> list[Rule]:
    """The rules by rejection per cost, most first; ties keep their order."""
    by = {name: share / max(cost, 1e-9) for name, cost, share in estimates}
    return sorted(rules, key=lambda r: -by[r.name])


def cascade(texts: list[bytes], rules: list[Rule], given: tuple[str, ...] = ()) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The position of the first rule that rejects each text (-1: kept), and the metrics computed on the way.

    Groups ``given`` are computed for all texts first; any other group only for
    the texts that no rule before the one that needs it has rejected.  A metric
    is -1 where the cascade ended before it was needed.
    """
    verdict = np.full(len(texts), -1, np.int64)
    metrics: dict[str, np.ndarray] = {}
    known = {g: np.ones(len(texts), bool) for g in given}
    for g in given:
        metrics |= GROUPS[g](texts)
    for k, rule in enumerate(rules):
        alive = np.flatnonzero(verdict < 0)
        if not len(alive):
            break
        for g in rule.groups:
            have = known.setdefault(g, np.zeros(len(texts), bool))
            need = alive[~have[alive]]
            if len(need):
                for name, values in GROUPS[g]([texts[i] for i in need]).items():
                    metrics.setdefault(name, np.full(len(texts), -1, np.int64))[need] = values
                have[need] = True
        verdict[alive[rule.rejects({m: v[alive] for m, v in metrics.items()})]] = k
    return verdict, metrics


#: The metrics that can be asked for, by the group that computes them.
METRICS = {"n_words": "counts", "word_chars": "counts", "n_symbols": "counts", "n_dup_lines": "lines", "n_repeat_words": "repeats"}


def apply_rules(docs: DataFrame, rules=RULES, keep=("doc_id",), metrics: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns ``keep`` of each row, ``rejected_by`` (null: kept), and the metrics asked for.

    rejected_by names the first rule of the planned order that rejects; whether
    one does depends on the text alone, which one on the order, which follows
    measured times.  The groups of the metrics asked for are computed for all
    texts, all others only as far as the cascade needs them.  Null texts are
    empty and so are rejected by few_words; equal texts of a run get equal
    verdicts; very long texts are judged as wholes; of ``keep``, columns named like the
    results give way to them; an empty table gives an empty result.
    """
    given = tuple(dict.fromkeys(METRICS[m] for m in metrics))
    planned = order(rules, estimate(docs, rules, sample_rows, given))
    names = [r.name for r in planned]
    keep = [c for c in keep if c.lower() not in {"rejected_by", *metrics}]
    fields = [*(docs.schema[c] for c in keep), T.StructField("rejected_by", T.StringType()), *(T.StructField(m, T.LongType()) for m in metrics)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                verdict, found = cascade(_texts(batch), planned, given)
                arrays = [*(batch.column(c) for c in keep), pa.array([names[k] if k >= 0 else None for k in verdict], pa.string()), *(pa.array(found[m]) for m in metrics)]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType(fields))


def sql() -> str:
    """DuckDB SQL of query op4."""
    return r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8
), k AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM g
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k) WHERE c > 1
), p AS (
  SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM d, range(0, 8) AS o(j) GROUP BY r
), l AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line FROM w
), n AS (
  SELECT r, count(*) AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n.n, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len([i for i in range(2, len(w) + 1) if w[i] = w[i - 1]]) AS n_stutters,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN n ON w.r = n.r LEFT JOIN p ON w.r = p.r
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR 2 * n_upper > n_letters OR 10 * n_stutters > 3 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""
