"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from loomframe import queries as lib

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else float(f"{v:.6g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(f"{v:.6g}") if abs(v) < 10**6 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(lib.QUERIES))
def test_query(spark, duck, name):
    df = lib.QUERIES[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(lib.SQL[name])
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
