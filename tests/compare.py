"""Runs registered queries against their DuckDB twins."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    try:
        return int(v) if not isinstance(v, str) and float(v) == int(v) else round(float(v), 9) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def differences(spark, con, sf, query, sql) -> str | None:
    """None if Spark and DuckDB agree, else what differs."""
    df = query(spark, sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    if not a:
        return "no rows"
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return f"{len(a)} and {len(b)} rows; only Spark: {sorted(sa - sb)[:2]}; only DuckDB: {sorted(sb - sa)[:2]}"
    return None
