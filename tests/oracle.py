"""Comparison of a query with its SQL twin on a folder of tables."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.sql(f"create view {f[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return repr(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())


def rows_of_sql(con, sql):
    names = sorted(con.sql(sql).columns)
    return sorted(tuple(plain(v) for v in r) for r in con.sql("select " + ", ".join(f'"{n}"' for n in names) + f" from ({sql})").fetchall())
