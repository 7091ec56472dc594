"""Run registered queries on both engines and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value.is_integer() else value)
    if hasattr(value, "to_integral_value"):
        return _cell(float(value))
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    order = sorted(df.columns)
    return order, Counter(tuple(_cell(r[c]) for c in order) for r in df.select(*order).collect())


def duck_rows(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    place = [names.index(c) for c in order]
    return order, Counter(tuple(_cell(r[i]) for i in place) for r in cursor.fetchall())


def differences(df, connection, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    columns, ours = spark_rows(df)
    expected_columns, expected = duck_rows(connection, sql)
    if columns != expected_columns:
        return f"columns {columns} against {expected_columns}"
    if ours != expected:
        extra, lacking = ours - expected, expected - ours
        return (
            f"{sum(extra.values())} unexpected rows such as {list(extra)[:3]}, "
            f"{sum(lacking.values())} missing rows such as {list(lacking)[:3]}"
        )
    return None
