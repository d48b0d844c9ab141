"""Runs a registered query and its SQL counterpart side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"HUGEINT": "bigint", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "SMALLINT": "smallint", "TINYINT": "tinyint"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        at = Path(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at / '*.parquet' if at.is_dir() else at}'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(round(value + 0.0, 9)))
    return (1, str(value))


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in data)


def compare(spark, con, folder: str, query, sql: str) -> str:
    """Empty if columns, kinds and rows agree; else what differs."""
    df = query(spark, folder)
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    right = rows(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = dict(df.dtypes)
    odd = [(c[0], kinds[c[0]], str(c[1])) for c in got.description if KINDS.get(str(c[1]), str(c[1])) != kinds[c[0]]]
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}; kinds {odd}"
    if left != right:
        a = next((x, y) for x, y in zip(left, right, strict=True) if x != y)
        return f"rows differ, first {a}; kinds {odd}"
    if not left:
        return "no rows"
    return f"kinds {odd}" if odd else ""
