"""Comparison of a Spark result with DuckDB's on the same tables, rows in any order."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(v)


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())


def duck_rows(con, sql):
    got = con.sql(sql)
    names = sorted(got.columns)
    at = [got.columns.index(c) for c in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
