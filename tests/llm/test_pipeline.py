import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lacuna.llm import simhash

SF = "/root/testdata/sf0.001"


def jaccard(a, b, size=5):
    x, y = (set(simhash.shingles((t or "").encode(), size)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_pipeline_end_to_end(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows
    total: dict = {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 1024
    assert Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).decode(rows[0].ids[:5])


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(11)
    return lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_near_duplicates_keep_one_of_each_group(spark, words):
    base = words(300)
    near = base.copy()
    near[150] = "other"
    half = base[:150] + words(150)
    texts = [(5, " ".join(base)), (3, " ".join(base).upper()), (8, " ".join(near)), (9, " ".join(half)), (10, " ".join(words(300))), (11, None), (12, ""), (13, "short text"), (13, "short text"), (None, "short text"), (14, "short other")]
    df = spark.createDataFrame([(d, t, None, "s", 1) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_duplicates(spark, df, SF)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert jaccard(" ".join(base), " ".join(near)) >= 0.8 > jaccard(" ".join(base), " ".join(half))
    kept = sorted(r.doc_id or -1 for r in out.collect())
    assert kept == [-1, 3, 9, 10, 11, 13, 14]
    assert corpus_pipeline.drop_duplicates(spark, df.limit(0), SF).collect() == []


def test_linked_but_dissimilar_texts_stay(spark, words, monkeypatch):
    """What SimHash proposes is verified: if everything is linked only the similar go."""
    a, b = " ".join(words(40)), " ".join(words(40))
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " tail")], "doc_id long, text string")

    def everything(distinct, radius):
        return distinct.select(simhash.F.col("fp").alias("a")).join(distinct.select(simhash.F.col("fp").alias("b")))

    monkeypatch.setattr(simhash, "link_fingerprints", everything)
    gone = {r.doc_id for r in simhash.duplicates(df).collect()}
    assert gone == {3}


def test_lines_and_toxic_documents(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    lines = corpus_pipeline.drop_lines(spark, kept, SF)
    assert lines.columns == docs.columns and lines.count() == kept.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())


def left_by_brute_force(texts, similarity=0.8, radius=simhash.DEDUP_RADIUS):
    """Ids that go: those like the least of their SimHash group, then text by text in the order of ids."""
    sets = {d: frozenset(simhash.shingles(t.encode(), 5)) for d, t in sorted(texts)}
    prints = {d: simhash._majority(simhash.shingle_set(t.encode(), 5)) for d, t in texts}

    def alike(d, e):
        return len(sets[d] & sets[e]) >= similarity * len(sets[d] | sets[e])

    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for d in sets:
            for e in sets:
                if label[e] < label[d] and ((prints[d] ^ prints[e]) & (1 << 64) - 1).bit_count() <= radius:
                    label[d], changed = label[e], True
    gone = {d for d in sets if label[d] < d and alike(label[d], d)}
    stay = []
    for d in sets:
        if d in gone:
            continue
        if any(alike(e, d) for e in stay):
            gone.add(d)
        else:
            stay.append(d)
    return gone


@pytest.mark.parametrize("heads", [(8, 64), (1, 2)])
def test_all_near_copies_are_found(spark, words, monkeypatch, heads):
    """Near copies more than 3 bits apart, chains, and a passage that many unlike texts share."""
    monkeypatch.setattr(simhash, "HEADS", heads)
    rng = np.random.default_rng(4)
    passage, texts = words(30), []
    for group in range(12):
        base = words(120) if group % 3 else [*passage, *words(8)]
        for _ in range(8):
            base = base.copy()
            for at in rng.integers(0, len(base), 1 + group % 3):
                base[at] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(base))
    texts = list(zip(rng.permutation(len(texts)).tolist(), texts, strict=True))
    want = left_by_brute_force(texts)
    prints = {d: simhash.fingerprint(t.encode(), 5) for d, t in texts}
    assert 20 < len(want) < len(texts) - 20
    assert any(min((prints[d] ^ p).bit_count() for e, p in prints.items() if e != d) > 3 for d in want)
    gone = {r.doc_id for r in simhash.duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert gone == want
