"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget (its target).  A target of E whole source sizes
and a fraction takes every document E times (complete epochs) and then fills the
fraction with documents in ascending order of the exponential key
``-ln(u) / quality``, where ``u`` is a fixed hash of the document: the weighted
sampling without replacement of Efraimidis and Spirakis.

The order within a source is never sorted as a whole.  Sizes are summed into
``BUCKETS`` slices of the key (partial sums before the shuffle), the slices are
prefix-summed, and only the slice in which the budget runs out is looked at
document by document.  A source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.llm.shared import materialise, word_count

#: Slices of the key space; a slice holds about 1/65536 of a source.
BUCKETS = 65536
#: Source tables of at most so many rows are broadcast.
BROADCAST_ROWS = 10_000
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain text, falling towards 0 with the symbols per word; 1 for null or no word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1))), F.lit(1.0))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds _size, _k (hex digest) and _e (exponential key) to each row."""
    size = word_count(F.col("text"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring("_k", 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52 + 1))
    return (
        docs.withColumn("_size", size)
        .withColumn("_k", digest)
        .withColumn("_e", -F.log(u) / quality_weight(F.col("text"), F.col("_size")))
    )


def _bucket() -> Column:
    return F.least(F.floor((1 - F.exp(-F.col("_e"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes.  A target stops at ``max_epochs`` source sizes; what is
    over is shared again by weight until none is above.  That level is found in
    closed form from one pass over the sources in order of cap per weight.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    t = t.withColumn("_r", F.col("_cap") / F.col("weight"))
    order = W.orderBy("_r", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    t = (
        t.withColumn("_rn", F.row_number().over(order))
        .withColumn("_cb", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_wb", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_t", F.sum("source_size").over(everything))
        .withColumn("_w", F.sum("weight").over(everything))
        .withColumn("_l", (F.col("_t") - F.col("_cb")).cast("double") / (F.col("_w") - F.col("_wb")))
    )
    level = F.min_by(
        F.when(F.col("_r") >= F.col("_l"), F.col("_l")), F.when(F.col("_r") >= F.col("_l"), F.col("_rn"))
    ).over(everything)
    t = t.withColumn("_level", level)
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The keyed slim table of all documents and the plan of each source.

    Plan: source, source_size, weight, target, epochs, and where the fraction
    ends (cut_bucket, cut_e, cut_k).
    """
    slim = materialise(_keyed(docs).select("doc_id", "source", "_size", "_k", "_e"))
    sizes = slim.groupBy("source").agg(F.sum("_size").alias("source_size"))
    plan = targets(sizes, weights, max_epochs)
    plan = plan.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialise(plan)
    slices = slim.groupBy("source", _bucket().alias("_b")).agg(F.sum("_size").alias("_s"))
    slices = slices.withColumnRenamed("source", "_src").join(
        plan.select("source", "_rest"), F.col("_src").eqNullSafe(F.col("source"))
    )
    upto = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    slices = slices.withColumn("_upto", F.sum("_s").over(upto))
    cut = (
        slices.filter(F.col("_upto") > F.col("_rest"))
        .groupBy("source", "_rest")
        .agg(F.min_by(F.struct("_b", (F.col("_upto") - F.col("_s")).alias("_before")), "_b").alias("_x"))
        .select(F.col("source").alias("_src"), F.col("_rest").alias("_left"), "_x._b", "_x._before")
    )
    last = (
        slim.withColumn("_bucket", _bucket())
        .join(F.broadcast(cut) if plan.count() <= BROADCAST_ROWS else cut, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_b")))
        .groupBy("_src", "_b", "_before", "_left", "_e", "_k")
        .agg(F.sum("_size").alias("_s"))
    )
    run = W.partitionBy("_src", "_b").orderBy("_e", "_k").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("_upto", F.col("_before") + F.sum("_s").over(run))
    nearer = (F.col("_upto") - F.col("_left")) < (F.col("_left") - (F.col("_upto") - F.col("_s")))
    taken = last.filter((F.col("_upto") <= F.col("_left")) | nearer)
    ends = taken.groupBy("_src").agg(F.max(F.struct("_e", "_k")).alias("_end"))
    full = plan.alias("p").join(cut.select("_src", "_b"), F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    full = full.join(ends, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    return slim, full.select(
        "source", "source_size", "weight", "target", "epochs",
        F.col("_b").alias("cut_bucket"), F.col("_end._e").alias("cut_e"), F.col("_end._k").alias("cut_k"),
    )


def _copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins each keyed row with its source's plan and adds ``copies``."""
    plan = materialise(plan)
    p = plan.withColumnRenamed("source", "_src")
    if plan.count() <= BROADCAST_ROWS:
        p = F.broadcast(p)
    b = _bucket()
    chosen = (b < F.col("cut_bucket")) | (
        (b == F.col("cut_bucket"))
        & ((F.col("_e") < F.col("cut_e")) | ((F.col("_e") == F.col("cut_e")) & (F.col("_k") <= F.col("cut_k"))))
    )
    copies = F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
    return keyed.join(p, F.col("source").eqNullSafe(F.col("_src"))).withColumn("copies", copies)


def mix_counts(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    Null texts have size 0; null sources are one source, ordered last.  Equal
    rows (same doc_id) have one key and are taken or left together.  A source of
    size 0 gets target 0 and no copies.  The last document of a source's
    fraction is taken if that brings the source nearer to its target.  An empty
    table gives an empty result; further columns are ignored.
    """
    slim, plan = mix_plan(docs.select("doc_id", "source", "text"), weights, max_epochs)
    return _copies(slim, plan).select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "copies"
    )


def mix_documents(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The mixed documents themselves: every row of ``docs`` repeated as often as the mix takes it.

    Columns are those of ``docs``, whatever their names.  Null and empty texts
    have size 0 and go along as often as their key falls; rows of one doc_id are
    taken together; an empty table gives an empty result.
    """
    _, plan = mix_plan(docs.select("doc_id", "source", "text"), weights, max_epochs)
    plan = plan.select("source", "epochs", "cut_bucket", "cut_e", "cut_k")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    out = _copies(_keyed(rows), plan).filter(F.col("copies") > 0)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def sql() -> str:
    """DuckDB SQL of query op8."""
    return r"""
WITH a AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS k FROM documents
), b AS (
  SELECT *, -ln((('0x' || substr(k, 1, 13))::BIGINT + 1) / (4503599627370497.0)::DOUBLE)
    / coalesce(1.0::DOUBLE / (1.0::DOUBLE + (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(size, 1)), 1.0::DOUBLE) AS e FROM a
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s
), r AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS r FROM w
), c AS (
  SELECT *, row_number() OVER o AS rn,
    coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
    coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
    sum(source_size) OVER () AS t, sum(weight) OVER () AS wt
  FROM r WINDOW o AS (ORDER BY r, source NULLS LAST)
), l AS (
  SELECT *, (t - cb)::DOUBLE / (wt - wb)::DOUBLE AS l FROM c
), v AS (
  SELECT arg_min(l, rn) AS level FROM l WHERE r >= l
), p AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM l, v
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM p
), d AS (
  SELECT b.doc_id, b.size, b.e, b.k, q.*, q.target - q.epochs * q.source_size AS rest,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.e, b.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(b.size) OVER (PARTITION BY b.source, b.e, b.k) AS own
  FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN upto <= rest OR (upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM d
"""
