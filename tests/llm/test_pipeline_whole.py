"""The chain of stages against plain versions, each on what its predecessor kept."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lacuna.llm import mixing, toxicity
from lacuna.llm.shared import materialise, table
from test_linededup import plain as plain_lines
from test_pipeline import left_by_brute_force
from test_toxicity import plain_score

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_equal_plain_versions(spark):
    docs = table(spark, SF, "documents")
    chain = toxicity.fit(docs, table(spark, SF, "labels"))
    kept = materialise(corpus_pipeline.drop_toxic(spark, docs, SF))
    assert rows(kept) == sorted((tuple(r) for r in docs.collect() if plain_score(chain, r.text)[0] < corpus_pipeline.TOXIC), key=str)

    lines = materialise(corpus_pipeline.drop_lines(spark, kept, SF))
    want = {d: t for d, t, _, _ in plain_lines([(r.doc_id, r.text, None) for r in kept.collect()])}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())

    single = materialise(corpus_pipeline.drop_duplicates(spark, lines, SF))
    texts = [(r.doc_id, r.text or "") for r in lines.collect()]
    first: dict = {}
    for d, t in sorted(texts):
        first.setdefault(tuple(t.encode().lower().split()), d)
    distinct = [(d, t) for d, t in texts if first[tuple(t.encode().lower().split())] == d]
    gone = left_by_brute_force(distinct)
    assert rows(single) == sorted((tuple(r) for r in lines.collect() if r.doc_id in {d for d, _ in distinct} - gone), key=str)

    mixed = materialise(corpus_pipeline.mix_sources(spark, single, SF))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in single.collect()]))
    taken = {d: n // s if s else None for d, s, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.sql()})").fetchall()}
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if taken[d] is not None}

    pieces = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*coder.encode(r.text or "", add_special_tokens=False).ids, 0] for r in mixed.collect()}
    assert all(list(p.ids) == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id]) for p in pieces)
    assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
    covered: dict = {}
    for p in pieces:
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    assert covered == {d: got[d] * len(ids[d]) for d in got}
    places: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == places.get(p.sequence_id, 0)
        places[p.sequence_id] = p.offset + p.length
    assert max(places.values()) <= 1024
