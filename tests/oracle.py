"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def _plain(x):
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else f"{round(float(x), 5) + 0.0:.5f}"
    return str(x)


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in data)


def differences(spark_df, sql: str, connection) -> str:
    """Empty if names and rows are equal."""
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    expected, got = found.fetchall(), spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    a, b = rows(spark_df.columns, got), rows(names, expected)
    if a == b:
        return ""
    first = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)
    return f"{len(a)} and {len(b)} rows; first difference {first}"
