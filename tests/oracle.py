"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import glob
import math
import os

import duckdb


def connect(directory):
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, query, sql, directory):
    """None if they agree, else what differs."""
    df = query(spark, directory)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    expected_names = [c[0] for c in result.description]
    expected, sorted_names = rows_of(expected_names, result.fetchall())
    if names != sorted_names:
        return f"columns {names}, expected {sorted_names}"
    if got != expected:
        a, b = set(map(repr, got)), set(map(repr, expected))
        return f"{len(got)} rows, expected {len(expected)}; only here {list(a - b)[:3]}; missing {list(b - a)[:3]}"
    return None
