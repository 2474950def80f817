"""Compares a query with its DuckDB equivalent, as multisets of rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(c)] for c in names) for r in rel.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want)) or sorted(map(repr, map(_plain, got))) == sorted(map(repr, map(_plain, want)))


def _plain(row):
    return tuple(float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row)
