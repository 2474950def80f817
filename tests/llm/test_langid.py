import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lacuna.llm import langid, queries

SF = "/root/testdata/sf0.01"


def plain_bits(model, text, order):
    """Code length of one text by the definition, byte by byte and context by context."""
    data = b" " * order + text
    total = 0.0
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8.0
                break
            seen = model[k].get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
    return total


def learned(texts, order):
    model: list[dict] = [{} for _ in range(order + 1)]
    for t in texts:
        data = b" " * order + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                model[k].setdefault(data[i - k : i], Counter())[data[i]] += 1
    return model


def grams(texts, order):
    counts = []
    for name, own in texts.items():
        c = Counter()
        for t in own:
            c.update(langid._grams(langid._padded([t], order), order + 1).tolist())
        counts += [(name, g, n) for g, n in c.items()]
    return counts


@pytest.mark.parametrize("order", [0, 2, 4, 6])
def test_tables_equal_the_definition(order):
    texts = {"a": [b"the cat and the hat", b"that is the end"], "b": ["der Hund und die Katze".encode(), "für die Ärzte".encode()], "c": [bytes(range(256)), "日本語の文".encode()]}
    trees = langid.Trees(grams(texts, order), order)
    probe = [b"the dog", "die Hüte".encode(), b"", b"\xc3\xa9\xff zz", b"tttttt", "日本の語".encode(), bytes(range(255, -1, -1))]
    got = trees.bits(probe)
    for k, name in enumerate(trees.languages):
        model = learned(texts[name], order)
        for i, text in enumerate(probe):
            assert abs(got[i, k] - plain_bits(model, text, order)) < 1e-3


def test_hash_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = langid.Table(keys)
    assert (table.rows(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)
    assert (table.rows(others) == -1).all() and (langid.Table(keys[:0]).rows(others) == -1).all()


def test_scripts_of_many_bytes(spark):
    """Languages that share a script other than Latin are told apart; no byte shares a code."""
    rng = np.random.default_rng(3)
    starts = {"x": 0x430, "y": 0x430, "z": 0x5D0, "w": 0x3B1, "v": 0x3042}
    rows = []
    for name, start in starts.items():
        stems = ["".join(chr(start + c) for c in rng.integers(0, 24, 3)) for _ in range(40)]
        rows += [(len(rows) + i, " ".join(rng.choice(stems, 30)), name) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.fit(df.filter("doc_id % 3 <> 0"))
    got = langid.identify(df.filter("doc_id % 3 = 0"), trees, ["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) == 1.0
    assert len({r.lang for r in got}) == 5 and set(np.unique(trees.pairs[0]).tolist()) == {b for t in rows if t[0] % 3 for b in (" " + t[1]).encode()}


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_langid(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "der Hund", None), (None, "123 !?", "de"), (6, "", "de"), (6, "", "de"), (7, "the " * 100_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.fit(df)
    got = langid.identify(df, trees, ["doc_id", "lang"]).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "en"), (2, "de"), (3, "und"), (4, "de"), (None, "und"), (6, "und"), (7, "en")} and len(got) == 8
    clash = langid.identify(df.withColumn("score", F.lit("x")), trees, ["doc_id", "score"])
    assert clash.columns == ["doc_id", "lang_pred", "score"] and clash.count() == 8
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.limit(0)), ["doc_id"]).collect()} == {"und"}
    assert langid.identify(df.limit(0), trees, ["doc_id"]).collect() == []
