import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacuna.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, length=1024):
    plain = Tokenizer.from_file(PATH)
    want = [(d, np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for d, t in docs]
    sequences: dict = {}
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert len(by) == len(docs)
    for doc_id, ids in want:
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = [sum(n for _, n in x) for x in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else length - n for n in sizes) / sum(sizes)


def test_query_is_an_exact_round_trip_with_little_padding(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check(queries.op7_pack(spark, SF).collect(), docs) < 0.02


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "  two  blanks\n\nand lines \n end\n"), (4, "tab\there\xa0there x"), (5, "<|endoftext|> x"), (6, "word. " * 5000), (7, "\x01a b"), (None, "no id")]
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, start long").coalesce(1)
    check(packing.pack(df, PATH).collect(), docs)
    assert packing.pack(df.limit(0), PATH).collect() == []
    ids = {r.doc_id: r.ids for r in packing.pack(df.filter("doc_id = 7"), PATH, with_ids=True).collect()}
    assert ids[7][-1] == 0


@given(st.text(alphabet="ab .,\n\t!'s1é ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_plain_encoding(text):
    plain = Tokenizer.from_file(PATH) if not hasattr(packing, "_plain") else packing._plain
    packing._plain = plain
    assert packing.encoder(PATH).encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_plan_is_optimal(gaps, seed):
    length = 16
    ends = np.cumsum(gaps)
    at, penalty = packing.cut_points(ends[:: seed + 1], ends, int(ends[-1]), length)
    at = np.unique(np.concatenate([at, np.arange(0, ends[-1], 7)]))
    pen = {int(p): int(c) for p, c in zip(*packing.cut_points(ends[:: seed + 1], ends, int(ends[-1]), length), strict=True)}
    penalty = np.array([pen.get(int(p), packing.HARD_CUT) for p in at])
    chosen = packing.plan(at, penalty, length, True)

    def pad(n):
        return 0 if n in (16, 8, 4) else length - n

    cost = {0: 0}
    for p, c in list(zip(at.tolist(), penalty.tolist(), strict=True))[1:]:
        cost[p] = min(cost[q] + pad(p - q) + c for q in cost if p - q <= length)
    got = sum(pad(b - a) for a, b in zip([0, *chosen], chosen, strict=False)) + sum(int(penalty[np.searchsorted(at, p)]) for p in chosen)
    assert got == cost[int(ends[-1])]


@given(st.text(alphabet="ab \n\t\r\x00\x01\x0b\x1c\x85\xa0 ​　\xe9<|", min_size=1, max_size=12))
@settings(max_examples=2000, deadline=None)
def test_odd_texts_are_those_of_the_pattern(text):
    pattern = r"[\x00\x01\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]|  |\n\n| \n|\n |<\||^[ \n]|[ \n]\Z"
    assert packing.odd(text) == bool(re.search(pattern, text))


def test_telling_odd_texts_takes_little_of_the_time():
    text = "Plain words, é one after another. " * 3000 + "end"
    places = "".join(text.replace("\n", " \n").split(" "))

    def took(run):
        began = time.process_time()
        for _ in range(20):
            run()
        return time.process_time() - began

    assert places and took(lambda: packing.odd(text)) < took(lambda: text.replace("\n", " \n").split(" "))


def test_every_white_space_is_odd():
    plain = {" ", "\n"}
    assert all(packing.odd(f"a{chr(c)}b") == (chr(c).isspace() and chr(c) not in plain or c < 2) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def test_a_worker_that_is_to_keep_nothing_drops_its_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", None]})
    rows = [[b.to_pylist() for b in packing._pack(PATH, 1024, 0, pa.int64(), True, 10, keep)(iter([batch]))] for keep in (True, False) if not packing._encoders.clear()]
    assert rows[0] == rows[1] and not packing._encoders
