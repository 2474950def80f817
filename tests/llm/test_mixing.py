from lacuna.llm import mixing, queries
from lacuna.llm.shared import table

SF = "/root/testdata/sf0.001"


def water_level(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while True:
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= most * sizes[s]
        free -= over


def test_targets_and_words_taken(spark):
    rows = queries.op8_mix(spark, SF).collect()
    source = {r.doc_id: r.source for r in table(spark, SF, "documents").collect()}
    sizes: dict = {}
    for r in rows:
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    want = water_level(sizes)
    taken: dict = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    biggest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= biggest for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op8_mix(spark, SF).collect()))


def test_documents_are_repeated_as_counted(spark):
    rows = [(1, "a b c", "s", None, "x"), (2, "d", "s", "de", "x"), (2, "d", "s", "de", "x"), (3, None, None, "en", "y"), (4, "e f", None, "en", "y"), (None, "g h i j", "t", "en", "z"), (6, "", "u", "en", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, copies string")
    counts = mixing.mix_counts(df).collect()
    assert len(counts) == 7
    assert all(r.copies == 0 for r in counts if r.source == "u")
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    want: dict = {}
    for r in counts:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix_counts(df.limit(0)).collect() == []
