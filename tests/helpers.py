"""Comparing a Spark result with DuckDB's."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(f"{v:.10g}"))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def same(df, con, sql):
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    found = con.sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    want = sorted(tuple(norm(x[i]) for i in at) for x in found.fetchall())
    assert rows == want
