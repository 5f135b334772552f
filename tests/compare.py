"""Runs queries in Spark and their SQL twins in DuckDB, and compares all rows."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if columns and rows agree."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = got.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    if ours == theirs:
        return ""
    mine, others = set(ours), set(theirs)
    a, b = [r for r in ours if r not in others][:3], [r for r in theirs if r not in mine][:3]
    return f"{len(ours)} rows against {len(theirs)}; only ours {a}; only theirs {b}"
