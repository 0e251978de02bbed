"""Compares a query's rows with its SQL's, column by column by name, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    got = connected(sf_dir).execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


def normal(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


#: DuckDB's types by Spark's.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def type_difference(df, sql: str, sf_dir: str) -> str:
    con = connected(sf_dir)
    theirs = {r[0]: str(r[1]) for r in con.execute(f"describe {sql}").fetchall()}
    ours = {c: KINDS.get(k, k) for c, k in df.dtypes}
    return ", ".join(f"{c}: {k} and {theirs.get(c)}" for c, k in ours.items() if theirs.get(c) != k)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both are the same."""
    (a, x), (b, y) = normal(df.columns, df.collect()), normal(*sql_rows(sql, sf_dir))
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} rows and {len(y)}; first: {x[:2]} and {y[:2]}"
    return next((f"row {p} and {q}" for p, q in zip(x, y) if p != q), "")
