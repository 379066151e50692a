"""Runs a query and its SQL on the same tables and compares the rows as sets of values."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("NETLOOM_DATA", "/root/testdata/sf0.001")


def connect(folder=DATA):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if type(x).__name__ in ("bool", "bool_"):
        return bool(x)
    if type(x).__name__ in ("list", "ndarray"):
        return tuple(map(plain, x))
    if type(x).__name__ in ("float", "float64", "float32", "Decimal", "int", "int64", "int32"):
        return f"{float(x):.9g}"
    return str(x)


def rows(df):
    return sorted((tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)))


def same(spark, query, sql, con, folder=DATA):
    mine, other = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
