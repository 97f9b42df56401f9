"""Rows of a Spark query against those of DuckDB's SQL over the same folder of parquet tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def check(spark, con, query, sql: str, folder: str = FOLDER) -> None:
    df = query(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    ran = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(ran.description)}
    assert sorted(at) == names
    want = Counter(tuple(plain(r[at[c]]) for c in names) for r in ran.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
