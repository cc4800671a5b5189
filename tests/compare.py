"""Comparing a Spark result with DuckDB's, order aside."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(root: str):
    con = duckdb.connect()
    for f in glob.glob(f"{root}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, otherwise a short account."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"{sum(got.values())} rows, want {sum(want.values())}; only spark {str(extra)[:700]}; only sql {str(missing)[:700]}"
