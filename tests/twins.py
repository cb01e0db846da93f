"""Comparing a query with its SQL twin: the same columns, the same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def differs(spark, con, query, sql: str, folder: str) -> str | None:
    """What tells the two results apart, None if nothing does."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    twin = con.execute(sql)
    names = [c[0] for c in twin.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    one = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    two = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in twin.fetchall()), key=repr)
    return None if one == two else f"{len(one)} and {len(two)} rows; only one has {list(set(one) ^ set(two))[:2]}"
