"""Rows of a frame and of DuckDB, comparable whatever their order."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter

import duckdb


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return c


def same_rows(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = df.collect()
    res = c.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = Counter(tuple(plain(r[n]) for n in order) for r in got)
    at = [names.index(n) for n in order]
    b = Counter(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
