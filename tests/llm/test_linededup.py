import hashlib

import numpy as np
import pytest

from lacuna.llm import linededup

LONG = "This line is long enough to be counted "
ROWS = [
    (1, f"{LONG}one\nshort\n  {LONG}TWO \t", "a"), (2, f"{LONG}One\nx\n{LONG}two\n{LONG}two", "a"), (3, f"\t{LONG}one\n", "a"),
    (4, None, None), (5, "", "b"), (None, f"{LONG}two\nlast", "b"), (7, "ééééééééééééééééééééé\nb", "c"), (8, "ÉÉÉ\nééééééééééééééééééééé", "c"),
    (9, "ééééééééééééééééééééé", "c"), (9, "ééééééééééééééééééééé", "c"), (10, "nineteen characters\nnineteen characters", "c"), (11, "nineteen characters", "c"), (12, "nineteen characters", "c"),
]


def plain(rows):
    def key(line):
        return line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()

    holders: dict = {}
    for doc_id, text, _ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(linededup.NULL_ID if doc_id is None else doc_id)
    out = []
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        own = linededup.NULL_ID if doc_id is None else doc_id
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == own]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("round_bytes", [linededup.ROUND_BYTES, 1])
def test_equals_brute_force(spark, monkeypatch, round_bytes):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, h1 string")
    got = linededup.dedup_lines(df, round_bytes=round_bytes)
    assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == sorted(plain(ROWS), key=str)
    assert sum(r.n_dropped for r in got.collect()) > 3


def test_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, h1 string").limit(0)
    assert linededup.dedup_lines(df).collect() == []


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(1)
    h1 = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    h2 = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    h1[:3] = h1[3]  # keys that share their first word end in the dictionary
    table = linededup.PerfectHash(h1, h2, np.arange(5000), np.arange(5000) * 7)
    at = table.find(h1, h2)
    assert len(table.fingerprint) + len(table.rest) == 5000
    assert sorted(at[at >= 0]) == list(range(len(table.fingerprint)))
    found, last = table.keeper(h1, h2)
    assert found.all() and (last == np.arange(5000) * 7).all()
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    more = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert not table.keeper(other, more)[0].any() and not table.keeper(h1, more)[0].any()
    assert linededup.PerfectHash(h1[:0], h2[:0], h1[:0], h1[:0]).keeper(h1, h2)[0].sum() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
