"""Compares a Spark result with DuckDB's for the SQL of a query, as sets of rows with counts."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql, folder):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(plain(r[i])) for i in order) for r in rows)


def assert_same(df, sql, folder):
    columns, want = run_sql(sql, folder)
    assert sorted(df.columns) == sorted(columns)
    got, expected = rows_of(df.columns, df.collect()), rows_of(columns, want)
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
