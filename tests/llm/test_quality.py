import pytest

from lacuna.llm import quality

CASES = [
    None, "", " \t\n", "one two", "a b c d e f g h\n" * 4, "word " * 30, "x" * 900 + " y" * 20,
    "the quick brown fox jumps over the lazy dog again and again until the sun has gone down behind hills", "é ü x #$ < > | a\nb\nb\n \n b",
]


def plain(text):
    words = (text or "").encode().split()
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for own in windows.values() if len(own) > 1 for i in own for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_stutters": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def test_metrics_equal_brute_force():
    texts = [(t or "").encode() for t in CASES]
    got: dict = {}
    for g in quality.GROUPS.values():
        got |= g(texts)
    for i, text in enumerate(CASES):
        for name, want in plain(text).items():
            assert got[name][i] == want, (name, text)


@pytest.mark.parametrize("reverse", [False, True])
def test_order_never_changes_a_verdict(reverse):
    texts = [(t or "").encode() for t in CASES]
    rules = list(quality.RULES)[:: -1 if reverse else 1]
    verdict, metrics = quality.cascade(texts, rules)
    kept = [all(not r.rejects({k: v[i : i + 1] for g in quality.GROUPS.values() for k, v in g(texts).items()})[0] for r in quality.RULES) for i in range(len(texts))]
    assert [v < 0 for v in verdict] == kept


def test_rejected_texts_are_spared_further_metrics(monkeypatch):
    """Groups not given are computed for the texts still standing alone, and given ones once for all."""
    asked: dict[str, list[int]] = {}

    def counted(name, run):
        return lambda texts: (asked.setdefault(name, []).append(len(texts)), run(texts))[1]

    monkeypatch.setattr(quality, "GROUPS", {g: counted(g, run) for g, run in quality.GROUPS.items()})
    texts = [(t or "").encode() for t in CASES]
    given = tuple(dict.fromkeys(quality.METRICS.values()))
    verdict, metrics = quality.cascade(texts, list(quality.RULES), given)
    assert all(asked[g] == [len(texts)] for g in given)
    base = sum(plain(t)["n_words"] >= 20 and 100 * plain(t)["n_repeat_words"] <= 30 * plain(t)["n_words"] for t in CASES)
    assert 0 < sum(asked["case"]) <= base < len(texts) and sum(asked["stutters"]) <= base
    assert (metrics["n_upper"] < 0).sum() == len(texts) - sum(asked["case"])


def test_order_is_by_rejection_per_cost():
    rules = quality.RULES[:3]
    found = quality.order(rules, [(rules[0].name, 1.0, 0.1), (rules[1].name, 0.1, 0.1), (rules[2].name, 1.0, 0.5)])
    assert [r.name for r in found] == [rules[1].name, rules[2].name, rules[0].name]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(None, "a b", None)] * 2, "doc_id long, text string, n_words string")
    rows = quality.apply_rules(df, keep=("doc_id", "n_words"), metrics=tuple(quality.METRICS)).collect()
    assert len(rows) == len(CASES) + 2
    assert [r.n_words for r in rows if r.doc_id is None] == [2, 2]
    lazy = {(r.doc_id, r.rejected_by is None) for r in quality.apply_rules(df).collect()}
    assert lazy == {(r.doc_id, r.rejected_by is None) for r in rows}
    assert quality.apply_rules(df.limit(0)).collect() == []
