"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import codes, graph, langid, licenses, linededup, mixing, packing, quality, simhash, topk, toxicity, urls, whitening
from lacuna.llm.shared import table

#: The url rules of query op2.
URL_RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit(urls.label_by_rules(pages, URL_RULES))
    return urls.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    scored = toxicity.tag(docs, toxicity.fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = tuple(quality.METRICS)
    judged = quality.apply_rules(table(spark, sf_dir, "documents"), metrics=metrics)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *metrics, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    best = F.get("matches", 0)
    return found.select("doc_id", best["license"].alias("license"), best["dice"].alias("dice"), best["first_line"].alias("first_line"), F.size("matches").alias("n_matches"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    trees = langid.fit(docs.filter(~held_out))
    found = langid.identify(docs, trees, ["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    book = codes.fit(rows, "vec_id", "embedding")
    if book is None:
        return rows.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = codes.summed_by(codes.encode(rows, "embedding", book), "label", "error", "label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, "embedding", components=4)
    if model is None:
        return rows.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    white = whitening.apply(rows, "embedding", model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.element_at(F.array(*[F.lit(e).cast("double") for e in model.explained]), F.col("at") + 1)
    return white.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return graph.nearest(graph.index(rows, "vec_id", "embedding"), rows.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", k=20)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_urls": op2_urls,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_langid": op6_langid,
    "op7_pack": op7_pack,
    "op8_mix": op8_mix,
    "op9_topk": op9_topk,
    "op10_lines": op10_lines,
    "op11_codes": op11_codes,
    "op12_whiten": op12_whiten,
    "op13_neighbours": op13_neighbours,
}
ORACLES = {"op4_quality": quality.sql(), "op8_mix": mixing.sql(), "op9_topk": topk.sql(), "op10_lines": linededup.sql(), "op11_codes": codes.sql()}
