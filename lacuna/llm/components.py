"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.shared import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, own: bool) -> DataFrame:
    """Each edge (u, v) with the least neighbour m of u (or u itself if ``own``)."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    if own:
        least = least.withColumn("m", F.least("_u", "m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node in an edge, root being the component's least node.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until the
    edges are stars; each is a partial minimum and a join, and every round is
    written to the shared folder.  Nodes of any degree are fine: minima are
    summed before the shuffle and skewed joins are split at run time.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialise(e)
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, True).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(materialise(large), False)
        e = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = e.unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = materialise(e)
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
