"""Declared columns that no given column stands for: derived from a row's number, word and day, in Spark and in SQL.

The value depends on the column's name too, so that two columns of a table differ and an exchange of columns shows.
One value in seven is null."""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.checks.oracle import moment
from wellspark.plans import tables as spec


class Base(NamedTuple):
    """What a row's missing columns are derived from: SQL or column names of a whole number, a text and a timestamp."""

    number: str
    word: str
    day: str


def _shift(name: str) -> int:
    return zlib.crc32(name.encode()) % 1000


def _derived(name: str, kind: str, base: Base) -> Column:
    # As text: one call to the JVM a column instead of one a function.
    n = f"(CAST({base.number} AS BIGINT) + {_shift(name)})"
    value = {
        "string": f"concat({base.word}, ' ', CAST({n} % 10 AS STRING))",
        "double": f"CAST({n} % 1000 AS DOUBLE)",
        "bigint": f"{n} % 1000",
        "timestamp": f"{base.day} + make_dt_interval(CAST({n} % 50 AS INT))",
        "boolean": f"if({n} % 2 = 0, 'true', 'false')",
    }[kind]
    return F.expr(f"if({n} % 7 <> 0, {value}, NULL) AS {name}")


def _derived_sql(name: str, kind: str, base: Base) -> str:
    n = f"({base.number} + {_shift(name)})"
    value = {
        "string": f"{base.word} || ' ' || ({n} % 10)",
        "double": f"{n} % 1000",
        "bigint": f"{n} % 1000",
        "timestamp": f"{base.day} + to_days(CAST({n} % 50 AS INTEGER))",
        "boolean": f"CASE WHEN {n} % 2 = 0 THEN 'true' ELSE 'false' END",
    }[kind]
    return f"CASE WHEN {n} % 7 <> 0 THEN {value} END"


def full(rows: DataFrame, declared: str, base: Base, *given: str | Column) -> DataFrame:
    """The given columns of a table and all others that are declared."""
    have = set(rows.select(*given).columns)
    missing = {name: kind for name, kind in spec.kinds(declared).items() if name not in have}
    return rows.select(*given, *(_derived(name, kind, base) for name, kind in missing.items()))


def full_sql(given: Mapping[str, str], declared: str, base: Base, text: bool = True) -> dict[str, str]:
    """Name to SQL of all declared columns in their order; the given ones as they are, derived timestamps as text."""
    out = {}
    for name, kind in spec.kinds(declared).items():
        value = _derived_sql(name, kind, base)
        out[name] = given.get(name) or (moment(value) if kind == "timestamp" and text else value)
    return out
