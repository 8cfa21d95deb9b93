"""Compare a registered query with its SQL twin, value by value."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def as_bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    return Counter(tuple(_plain(row[place]) for place in order) for row in rows)


def differences(frame, connection, sql: str) -> list[str]:
    """Human-readable differences, none when both sides agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = as_bag(names, result.fetchall())
    found = as_bag(frame.columns, frame.collect())
    notes = []
    if sorted(names) != sorted(frame.columns):
        notes.append(f"columns {sorted(frame.columns)} against {sorted(names)}")
    missing, surplus = expected - found, found - expected
    if missing:
        notes.append(f"{sum(missing.values())} missing, such as {next(iter(missing))}")
    if surplus:
        notes.append(f"{sum(surplus.values())} surplus, such as {next(iter(surplus))}")
    return notes
