"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  Further columns of the
documents are left behind by the first stage; every stage takes nulls in any
column, empty and very long texts, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import linededup, mixing, packing, simhash, toxicity
from lacuna.llm.shared import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of at least this toxicity are rejected.
TOXIC = 0.5
#: Units that a worker remembers while packing a partition; other stages use the same workers, so it keeps nothing beyond.
REMEMBERED = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the toxicity chain, fitted to all labels, scores as toxic.

    Null and empty texts have no toxic word and stay; equal texts go or stay
    together; a long text is scored by the density of its toxic words.
    """
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.tag(docs, chain, list(COLUMNS), score="_toxicity", spans=None)
    return scored.filter(F.col("_toxicity") < TOXIC).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand in three documents or more, but for the largest doc_id; texts get their new length.

    No document goes: null and empty texts come back empty.  Rows of one doc_id
    are one document, so they keep their lines together; null ids are one
    document below all others.
    """
    kept = linededup.dedup_lines(docs.select(*COLUMNS), n_lines="_lines", n_dropped="_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near-duplicates on five-word shingles.

    Null and empty texts are copies of each other; equal texts under one doc_id
    become one row, other texts under it are documents of their own; rows without
    a doc_id stay.
    """
    return simhash.dedup_documents(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and selects documents so that the sources have their target weights.

    Texts without words have size 0 and go along as their key falls; ties of
    keys (repeated rows) are taken together; null is a source of its own.
    """
    return mixing.mix_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into token sequences; one row per piece, with its ids.

    A null or empty text is its end token alone; repeated rows are documents of
    their own; very long texts run over as many sequences as they need.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, remember=REMEMBERED, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The chain and the key order of the mix have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
