"""Clashing names, ids of other types and odd rows, operator by operator and stage by stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import licenses, linededup, mixing, packing, shared, toxicity

SF = "/root/testdata/sf0.001"
LINE = "the same long line that stands in many documents"
ROWS = [
    (1, None, "en", "s", 0), (2, "", None, None, None), (3, f"{LINE}\nown words of three", "en", "s", 1), (4, f"{LINE}\nfour", "de", "t", 2), (5, f" {LINE.upper()}\t\nfive", "de", None, 3),
    (5, f" {LINE.upper()}\t\nfive", "de", None, 3), (6, "word " * 60_000, "en", "s", 300_000), (None, "no id here", "en", "t", 10), (None, "no id here", "en", "t", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


def test_clashing_names(spark, docs):
    own = docs.withColumnsRenamed({"lang": "_k", "n_chars": "_size"}).withColumn("copies", F.lit("mine"))
    mixed = mixing.mix_documents(own)
    assert mixed.columns == own.columns and {r["copies"] for r in mixed.collect()} == {"mine"}
    assert {r["_k"] for r in mixed.collect()} <= {"en", "de", None}
    lines = docs.withColumnsRenamed({"lang": "N_lines", "n_chars": "_drops"})
    for round_bytes in (linededup.ROUND_BYTES, 1):
        out = linededup.dedup_lines(lines, round_bytes=round_bytes)
        assert out.columns == ["doc_id", "text", "source", "_drops", "n_lines", "n_dropped"]
        assert sorted(r.n_dropped for r in out.collect()) == [0] * 7 + [1, 1]
    scanned = licenses.scan(docs.withColumn("matches", F.lit(1)), ["doc_id", "matches"])
    assert scanned.columns == ["doc_id", "matches"] and scanned.schema["matches"].dataType.typeName() == "array"
    chain = toxicity.Chain([{}, {}, {}, {}], -10.0, toxicity.np.zeros((2, 2)), (0.0, 0.0, 0.0))
    assert toxicity.tag(docs.withColumn("Score", F.lit(1)), chain, ["doc_id", "Score"]).columns == ["doc_id", "score", "spans"]


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,2)", "string", "date"])
def test_ids_of_any_plain_type(docs, kind):
    value = F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast(kind)
    out = packing.pack(docs.withColumn("doc_id", value), public_tokenizers.path("byte_bpe_50k.json"))
    assert dict(out.dtypes)["doc_id"] == kind and out.agg(F.sum("length")).first()[0] == out.select("doc_id", "start", "length", "doc_tokens").agg(F.sum("length")).first()[0]
    assert {r.doc_id is None for r in out.collect()} == {True, False}


def test_stages_take_odd_rows(spark, docs):
    """Every stage of the pipeline on nulls, empty and very long texts, repeated rows and an empty table."""
    scored = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert scored.columns == docs.columns and scored.count() == len(ROWS)
    lines = corpus_pipeline.drop_lines(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in lines if r.doc_id in (3, 4, 5)) == [(3, "own words of three"), (4, "four"), (5, ROWS[4][1]), (5, ROWS[4][1])]
    assert all(r.n_chars == len(r.text) for r in lines)
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.drop_duplicates(spark, docs, SF).collect())
    assert kept == sorted(["1", "3", "4", "5", "6", "None", "None"])
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in ROWS}
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert sum(len(r.ids) for r in packed) == sum(r.length for r in packed) and max(r.offset + r.length for r in packed) <= 1024
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)
    for name, stage in corpus_pipeline.STAGES:
        if name != "toxicity":
            assert stage(spark, docs.limit(0), SF).collect() == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            class Empty:
                @staticmethod
                def isDefined():  # noqa: N802
                    return False

            return Empty

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
