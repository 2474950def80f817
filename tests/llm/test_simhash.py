import random

import numpy as np
import pytest
import xxhash

from lacuna.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    items = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    ids, fps = [r[0] for r in rows], [r[1] for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and bin(fps[i] ^ fps[j]).count("1") <= radius:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = {}
    for i, k in enumerate(label):
        if ids[i] is not None:
            out[k] = min(out.get(k, ids[i]), ids[i])
    return [out.get(k) for k in label]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    want = {(i, f"{fp:016x}", c) for (i, fp), c in zip(rows, plain_components(rows), strict=True)}
    got = queries.op1_simhash(spark, SF).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


@pytest.mark.parametrize("node_rows", [2048, 12, 2])
def test_planted_fingerprints(spark, monkeypatch, node_rows):
    """Chains, far pairs and a dense group, with and without split nodes."""
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
                x ^= 1 << b
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << b) for b in range(40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.link_fingerprints(df, 2).collect()
    index = {x - (1 << 64) if x >> 63 else x: i for i, x in enumerate(fps)}
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in links)
    roots = {r.node: r.root for r in simhash.components(simhash.link_fingerprints(df, 2), "a", "b").collect()}
    want = plain_components([(i, x) for i, x in enumerate(fps)])
    got = [roots.get(x, x) for x in index]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("mask", [0, 0xFFF, 0xFF00000000000FF0])
def test_gray_index_finds_all_pairs(mask):
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64) << np.uint64(20) | rng.integers(0, 2, 700, dtype=np.uint64))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2 and not int(fps[i] ^ fps[j]) & mask}
    index = simhash.GrayIndex(fps, mask)
    got = [tuple(sorted(x)) for a, b in index.pairs(2, block=50) for x in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_links_come_from_the_index_and_it_prunes(monkeypatch):
    """All links of a task are found by searches that drop most groups; without the index there are none."""
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:200] ^ np.uint64(1 << 40), fps[200:300] ^ np.uint64(3 << 62)]))
    masks = [m for m, _ in simhash._masks(2)]
    batches = [simhash.pa.RecordBatch.from_pydict({"route": [r] * len(fps), "fp": fps.view(np.int64)}, schema=simhash.pa.schema([("route", simhash.pa.int32()), ("fp", simhash.pa.int64())])) for r in range(len(masks))]
    made, own = [], simhash.GrayIndex

    def noted(*args):
        made.append(own(*args))
        return made[-1]

    monkeypatch.setattr(simhash, "GrayIndex", noted)
    links = {tuple(sorted((int(a), int(b)))) for out in simhash._linker(2, masks)(iter(batches)) for a, b in zip(out["a"].to_numpy().view(np.uint64), out["b"].to_numpy().view(np.uint64), strict=True)}
    near = {tuple(sorted((int(fps[i]), int(fps[j])))) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2) if i < j}
    assert links == near and len(near) == 300
    assert len(made) == len(masks) and all(0 < x.looked < len(fps) ** 2 // 20 and x.dropped > 0.8 * x.looked for x in made)
    monkeypatch.setattr(own, "pairs", lambda *args: iter(()))
    assert not any(out.num_rows for out in simhash._linker(2, masks)(iter(batches)))


@pytest.mark.parametrize("chunk", [simhash.CHUNK_HASHES, 50])
def test_postings_are_the_prefixes_by_exact_counts(spark, monkeypatch, chunk):
    """Whatever the chunks: a text's rarest shingles, less those that no other text has."""
    monkeypatch.setattr(simhash, "CHUNK_HASHES", chunk)
    texts = [f"w{i % 7} w{i % 5} w{i % 3} common words here w{i // 3} w{i // 2} w{i // 3} end of it" for i in range(300)] + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = {i: simhash.shingle_set((t or "").encode(), 5) for i, t in enumerate(texts)}
    true: dict = {}
    for own in sets.values():
        for h in own.tolist():
            true[h] = true.get(h, 0) + 1
    want = set()
    for i, own in sets.items():
        counts = np.array([min(true[h], simhash.MOST) for h in own.tolist()], np.int64)
        want |= {(i, len(own), simhash._majority(own), pos, h) for pos, h in enumerate(simhash.prefix(own, 0.8, counts).view(np.int64).tolist()) if true[h & (1 << 64) - 1] > 1}
    got = [tuple(r) for r in simhash.postings(df, 5, 0.8).select("id", "n", "fp", "pos", "x").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert simhash.postings(df.limit(0), 5, 0.8).collect() == []


@pytest.mark.parametrize("buckets", [1, 3, 9])
def test_chunks_do_not_move(spark, monkeypatch, buckets):
    """With fewer or more buckets than the shuffle has partitions: only hashes by range and their counts are shuffled."""
    texts = [f"w{i % 7} w{i % 5} w{i % 3} common words here w{i // 3} w{i // 2} w{i // 3} end of it" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(simhash, "CHUNK_HASHES", 50)
    want = {tuple(r) for r in simhash.postings(df, 5, 0.8).collect()}
    plans, own = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df))
    monkeypatch.setattr(simhash, "BUCKET_HASHES", sum(map(len, texts)) / 6 / (buckets - 0.5))
    assert {tuple(r) for r in simhash.postings(df, 5, 0.8).collect()} == want and want
    (plan,) = plans
    assert plan.count("Bucketed: true") == 2 and "Bucketed: false" not in plan
    assert plan.count("- Exchange ") == 2 and plan.count("REPARTITION_BY_NUM") == 1


def test_batches_of_chunks_are_small(spark, monkeypatch):
    """While chunks pass through Python a batch holds two or so; afterwards the session has its own bound again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held, own = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df: held.append(spark.conf.get(key)) or own(df))
    simhash.small_batches(spark)
    before = spark.conf.get(key)
    df = spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(9)], "doc_id long, text string")
    simhash.postings(df, 5, 0.8)
    assert held == [str(simhash.CHUNK_BATCH)] and spark.conf.get(key) == before != held[0]


def test_edges_of_input(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e", "y"), (4, "A b\tC d e", "y"), (4, "A b\tC d e", "y"), (9, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.component_id) for r in got}
    assert {(1, 1), (2, 1), (None, 4), (4, 4), (9, 9)} == by
    assert next(r.fp for r in got if r.doc_id == 2) == 0
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_no_text_is_lost_under_a_repeated_id(spark):
    """Rows of one id with other texts are documents of their own; only copies go, and the same ones in every run."""
    base = [f"w{i}" for i in range(60)]
    copy, near = " ".join(base), " ".join([*base[:58], "x", "y"])
    rows = [(1, copy, "b"), (5, near, "b"), (5, "a unique text of its own under the same id", "c"), (5, "a unique text of its own under the same id", "a"), (7, None, "n"), (7, "", "n"), (8, "", "n"), (None, copy, "z"), (None, copy, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for far in (simhash.FAR, 64):
        got = sorted(((r.doc_id or 0, r.text or "", r.source) for r in simhash.dedup_documents(df, far=far).collect()))
        assert [g for g in got if g[0] not in (7,)] == [(0, copy, "z"), (0, copy, "z"), (1, copy, "b"), (5, rows[2][1], "a")]
        assert len([g for g in got if g[0] == 7]) == 1  # null and empty are copies
    assert simhash.dedup_documents(df).columns == df.columns
