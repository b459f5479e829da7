"""Comparing a query with its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str):
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(cell, value))
    return value if value is None or isinstance(value, (int, bool, str)) else str(value)


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


def assert_same(df, connection, sql):
    found = connection.execute(sql).fetchall()
    columns = [d[0] for d in connection.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(found, columns)
