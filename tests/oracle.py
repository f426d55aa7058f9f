"""Comparison of a query's rows with DuckDB's on the same tables."""

import decimal
import math
import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
