"""Regrouping joined rows into one row per well, and nesting columns by table prefix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.operators.lists import fold_lists


def regroup(
    df: DataFrame, key: str, list_prefixes: Sequence[str], order: Sequence[str], empty_list_cols: Sequence[str] = ()
) -> DataFrame:
    """One row per key: columns with a listed prefix become lists over the rows, the others keep their first non-null.

    Rows without a key are dropped. Nulls and inner arrays are kept; `empty_list_cols` are
    array columns whose nulls become empty arrays inside the list.
    """
    df = df.dropna(subset=[key])
    fill = {c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in empty_list_cols}
    df = df.withColumns(fill) if fill else df
    listed = [c for c in df.columns if c.startswith(tuple(list_prefixes))]
    plain = [c for c in df.columns if c not in listed and c != key and c not in order]
    return fold_lists(df, [key], order, listed, firsts=plain)


def prefixed(df: DataFrame, prefix: str, cols: Sequence[str] | None = None) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in (cols or df.columns)])


def nest_by_prefix(df: DataFrame, tables: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One struct per table, prefix stripped, first matching prefix wins; other columns are left out.

    Decided once from the column names; `keep` columns stay at the top level.
    """
    members: dict[str, list[Column]] = {}
    for name in df.columns:
        if name in keep:
            continue
        for prefix, table in tables.items():
            if name.startswith(prefix):
                members.setdefault(table, []).append(F.col(f"`{name}`").alias(name[len(prefix) :]))
                break
    structs = [F.struct(*cols).alias(table) for table, cols in members.items()]
    return df.select(*keep, *structs)


def max_changed(df: DataFrame, keys: Sequence[str], column: str = "row_changed_date") -> DataFrame:
    """Latest change per group, for incremental exports."""
    return df.groupBy(*keys).agg(F.max(column).alias("max_" + column))
