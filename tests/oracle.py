"""Holds a Spark result against DuckDB: same columns, same rows, floats to nine digits."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            p = f"{sf_dir}/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if Path(p).is_dir() else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """How many rows both have."""
    got = rows(df.columns, df.collect())
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want = rows(columns, res.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want, f"{sum(got.values())} rows, {sum(want.values())} wanted; extra {list((got - want).items())[:3]}, missing {list((want - got).items())[:3]}"
    return sum(got.values())
