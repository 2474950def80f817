"""Reading incomplete tables: missing is NULL, once and for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def coerce(df: DataFrame, features: list[str], label: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features as nullable doubles with NaN turned to NULL; a string label stays as it is, ``keep`` passes through."""
    kinds = dict(df.dtypes)
    missing = [c for c in [*features, *([label] if label else []), *keep] if c not in kinds]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")
    nested = [c for c in features if kinds[c].startswith(("array", "map", "struct", "binary", "udt"))]
    if nested:
        raise TypeError(f"features must be plain numeric columns, not {', '.join(f'{c} ({kinds[c]})' for c in nested)}")
    columns = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features]
    if label:
        text = kinds[label] == "string"
        columns.append(F.col(label) if text else F.nanvl(F.col(label).cast("double"), F.lit(None).cast("double")).alias(label))
    return df.select(*keep, *columns)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with header; an empty field is NULL."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", nanValue="NaN")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Result sink: Parquet or CSV, replaced as a whole."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.option("header", True).format(fmt).save(path)


#: Deterministic masks over the test tables: view -> (table, key, columns, where each is NULL by the key k).
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "m_lineitem": (
        "lineitem",
        "7 * l_orderkey + 13 * l_linenumber",
        {
            "y": "CAST(l_tax AS DOUBLE)",
            "x1": "CASE WHEN k % 10 >= 2 THEN CAST(l_quantity AS DOUBLE) END",
            "x2": "CASE WHEN k % 7 >= 1 THEN CAST(l_extendedprice AS DOUBLE) END",
            "x3": "CASE WHEN k % 5 >= 1 THEN CAST(l_discount AS DOUBLE) END",
            "g": "l_returnflag",
            "y_lin": "CASE WHEN k % 13 >= 1 THEN 3 + CAST(0.5 AS DOUBLE) * l_quantity - 20 * l_discount + 100 * (l_tax - CAST(0.04 AS DOUBLE)) END",
            "y_bin": "CASE WHEN k % 13 >= 1 THEN CASE WHEN 3 + CAST(0.5 AS DOUBLE) * l_quantity - 20 * l_discount + 100 * (l_tax - CAST(0.04 AS DOUBLE)) > 15 THEN 1 ELSE 0 END END",
        },
    ),
    "m_mono": (
        "orders",
        "o_orderkey",
        {
            "x1": "CASE WHEN k % 10 >= 2 THEN CAST(0.001 AS DOUBLE) * o_totalprice END",
            "x2": "CAST(o_custkey % 50 AS DOUBLE)",
            "y_lin": "2 + CAST(0.00005 AS DOUBLE) * o_totalprice - CAST(0.3 AS DOUBLE) * (o_custkey % 50) + (k % 17)",
        },
    ),
    "m_part": (
        "part",
        "p_partkey",
        {
            "y": "CASE WHEN k % 11 >= 1 THEN CAST(p_retailprice AS DOUBLE) END",
            "x1": "CASE WHEN k % 6 >= 1 THEN CAST(p_size AS DOUBLE) END",
            "x2": "p_size + CAST(0.1 AS DOUBLE) * p_retailprice",
            "g": "p_brand",
        },
    ),
    "m_customer": (
        "customer",
        "c_custkey",
        {
            "y": "CASE WHEN k % 9 >= 1 THEN CAST(c_acctbal AS DOUBLE) END",
            "x1": "CASE WHEN k % 8 >= 2 THEN CAST(c_nationkey AS DOUBLE) END",
            "g": "c_mktsegment",
        },
    ),
    "m_events": (
        "events",
        "event_id",
        {
            "y": "CASE WHEN k % 12 >= 1 THEN CAST(value AS DOUBLE) END",
            "x1": "CASE WHEN k % 7 >= 2 THEN CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) END",
            "x2": "CASE WHEN k % 10 >= 1 THEN CAST(user_id AS DOUBLE) END",
            "g": "user_id",
        },
    ),
    "m_orders": (
        "orders",
        "o_orderkey",
        {
            "y": "CASE WHEN k % 3 = 0 AND o_orderstatus = 'F' THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END",
            "x1": "CASE WHEN k % 10 >= 2 THEN CAST(datediff({day}CAST(o_orderdate AS DATE), DATE '1995-01-01') AS DOUBLE) END",
            "g": "o_custkey",
            "y_grp": "CAST(0.00001 AS DOUBLE) * o_totalprice + (o_custkey % 7)",
        },
    ),
}


def masked(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the masked views: k, y, features x1.., group g and constructed outcomes."""
    table, key, columns = VIEWS[view]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn("k", F.expr(key))
    return rows.select("k", *[F.expr(e.format(day="")).alias(c) for c, e in columns.items()])


def masked_sql(view: str) -> str:
    """The same view as a DuckDB subquery."""
    table, key, columns = VIEWS[view]
    body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    body = body.replace("datediff({day}CAST(o_orderdate AS DATE), DATE '1995-01-01')", "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))")
    return f"(SELECT k, {body} FROM (SELECT *, {key} AS k FROM {table}))"
