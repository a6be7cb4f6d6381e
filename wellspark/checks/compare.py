"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_value(v) for v in value)
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns and rows agree as bags, else a description."""
    result = connection.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    if sorted(theirs_columns) != sorted(df.columns):
        ours, theirs = set(df.columns), set(theirs_columns)
        return f"columns differ: only ours {sorted(ours - theirs)}, only SQL {sorted(theirs - ours)}"
    theirs = _bag(theirs_columns, result.fetchall())
    ours = _bag(df.columns, df.collect())
    if ours == theirs:
        return None
    missing, extra = theirs - ours, ours - theirs
    sample = f"ours {next(iter(extra), None)}\nSQL  {next(iter(missing), None)}"
    return f"{sum(ours.values())} rows against {sum(theirs.values())}, {sum(extra.values())} differ\n{sample}"
