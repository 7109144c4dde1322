"""Compares a query with its SQL on DuckDB, as multisets of rows."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, Decimal)):
        return Decimal(v).normalize() if v else Decimal(0)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return str(v).replace("+00:00", "")


def duck(sql: str, data: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    return names, cur.fetchall()


def compare(spark, f, sql: str, data: str = DATA) -> int:
    df = f(spark, data)
    names, rows = duck(sql, data)
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    order = sorted(names)
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rows)
    assert ours == theirs, f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours: {list((ours - theirs).items())[:3]}; only SQL: {list((theirs - ours).items())[:3]}"
    return len(rows)
