"""Runs queries against their SQL in DuckDB, as the driver does."""

import glob
import math
import os
from collections import Counter

import duckdb


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def same_rows(spark, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    cur = connect(folder).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
