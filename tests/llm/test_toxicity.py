import itertools
import re

import numpy as np
import pytest

from lacuna.llm import queries, toxicity

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk", [2, 3, 256])
def test_marginals_equal_enumeration(chunk):
    rng = np.random.default_rng(2)
    a = np.exp(rng.normal(size=(2, 2)))
    sizes = np.array([1, 5, 0, 8, 3])
    x = np.exp(rng.normal(size=int(sizes.sum())))
    got = np.split(toxicity.chain_marginals(x, sizes, a, chunk), np.cumsum(sizes)[:-1])
    for own, part in zip(np.split(x, np.cumsum(sizes)[:-1]), got, strict=True):
        weight = np.zeros(len(own))
        total = 0.0
        for path in itertools.product((0, 1), repeat=len(own)):
            w = np.prod([f if y else 1.0 for f, y in zip(own, path, strict=True)]) * np.prod([a[i, j] for i, j in itertools.pairwise(path)])
            total += w
            weight += w * np.array(path)
        if len(own):
            assert np.allclose(part, weight / total)


def test_pair_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    a = np.exp(rng.normal(size=(2, 2)))
    sizes = np.array([4, 2])
    x = np.exp(rng.normal(size=6))
    fore, back = toxicity.chain_messages(x, sizes, a, 3)
    got = toxicity.pair_marginals(fore, back, x, sizes, a)
    want = np.zeros(4)
    for own in (x[:4], x[4:]):
        total, sums = 0.0, np.zeros(4)
        for path in itertools.product((0, 1), repeat=len(own)):
            w = np.prod([f if y else 1.0 for f, y in zip(own, path, strict=True)]) * np.prod([a[i, j] for i, j in itertools.pairwise(path)])
            total += w
            for i, j in itertools.pairwise(path):
                sums[2 * i + j] += w
        want += sums / total
    assert np.allclose(got, want)


def plain_score(chain, text):
    """The score by the textbook recursion, one token after another."""
    words = (text or "").encode().split()
    a = np.exp(chain.moves)
    x = [np.exp(np.clip(chain.bias + sum(w.get(f, 0.0) for w, f in zip(chain.weights, toxicity.features(toxicity.token(t)), strict=True)), -30, 30)) for t in words]
    fore, back = [], [np.ones(2)]
    for k, f in enumerate(x):
        v = (fore[-1] @ a if k else np.ones(2)) * np.array([1, f])
        fore.append(v / v.sum())
    for f in reversed(x[1:]):
        v = a @ (back[-1] * np.array([1, f]))
        back.append(v / v.sum())
    p = np.array([(f * b)[1] / (f * b).sum() for f, b in zip(fore, reversed(back), strict=True)]) if words else np.empty(0)
    return 1 / (1 + np.exp(-np.dot(chain.calibration, toxicity.summary(p)))), p


def test_scores_equal_plain_recursion(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit(docs, labels)
    rows = toxicity.tag(spark.read.parquet(f"{SMALL}/documents.parquet"), chain, ["doc_id", "text"]).collect()
    assert len(rows) == 200 and sum(len(r.spans) for r in rows)
    for r in rows:
        score, p = plain_score(chain, r.text)
        assert abs(r.score - score) < 1e-9
        assert [(s.start, s.end) for s in r.spans] == [m.span() for m, v in zip(re.finditer(r"[^\x20\x09-\x0D]+", r.text or ""), p, strict=True) if v > 0.5]


def test_length_alone_is_not_toxic(spark):
    """Clean documents joined into long ones stay clean, and toxic ones toxic."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit(docs, labels)
    rows = toxicity.tag(docs.join(labels, "doc_id"), chain, ["text", "toxic"], spans=None).orderBy("text").collect()
    for toxic in (0, 1):
        texts = [r.text for r in rows if r.toxic == toxic and (r.score >= 0.3) == bool(toxic)]
        for n in (10, 50):
            joined = [(" ".join(texts[i : i + n]),) for i in range(0, max(1, len(texts) - n), n)]
            scores = [r.score for r in toxicity.tag(spark.createDataFrame(joined, "text string"), chain, [], spans=None).collect()]
            assert scores and all((s >= 0.3) == bool(toxic) for s in scores)


def test_words_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(toxicity, "_REMEMBERED", 3)
    chain = toxicity.Chain([{"bad": 3.0}, {"bad": 1.0}, {}, {"bad": 0.5}], -4.0, np.zeros((2, 2)), (0.0, 0.0, 0.0))
    texts = [[b"a", b"Bad!", b"c"], [b"d", "été".encode(), b"bad"], [b"...", b"a", b"x" * 100]]
    want = [[plain_score(chain, b" ".join(t).decode())[1] for t in texts]]
    got = [np.concatenate([chain.marginals([t])[0] for t in texts]) for _ in range(3)]
    assert all(np.allclose(g, np.concatenate(want[0])) for g in got)
    assert [toxicity.token(w) for w in (b"Bad!", b"...", "«Été»".encode(), b"a-b")] == ["bad", "", "été", "a-b"]


def test_held_out_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    known = [(r.predicted, toxic[r.doc_id]) for r in rows if r.doc_id in toxic]
    assert np.mean([p == t for p, t in known]) > 0.95
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([p == t for p, t in held]) > 0.93


def test_spans_and_odd_rows(spark):
    clean = ["the river runs to the sea", "a stone in the garden", "bread and salt on the table", "rain falls over the hill"]
    docs, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        docs.append((i, clean[i // 4 % 4] + (" you Idiot! and moron" if bad else "") + f" w{i}", "s"))
        labels.append((i, 0, int(bad)))
    docs += [(500, None, "s"), (501, "", "s"), (502, "salt IDIOT, table", "s"), (None, "rain", None), (None, "rain", None), (503, "sea " * 60_000, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None), (502, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(df, marks)
    rows = {r.doc_id: r for r in toxicity.tag(df.select("doc_id", "text"), chain, ["doc_id", "text"]).collect()}
    assert rows[500].score == rows[501].score < 0.3 and rows[503].score < 0.3 and not rows[501].spans
    assert rows[502].score > 0.3
    assert [rows[502].text[s.start : s.end] for s in rows[502].spans] == ["IDIOT,"]
    assert all((rows[i].score > 0.3) == (i % 4 == 0) for i in range(120))
    assert toxicity.tag(df.limit(0), chain, ["doc_id"]).collect() == []
    flat = toxicity.fit(df, marks.filter("toxic = 0"))
    assert len({round(r.score, 12) for r in toxicity.tag(df, flat, ["doc_id"], spans=None).collect()}) == 1
