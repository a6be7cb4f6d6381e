"""Documents as plain columns, so that two engines can be compared value by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions.values import timestamp_text

NULL_MARK, ITEM, ROW = "~", "|", ";"


def joined(value: Column, dtype: T.ArrayType) -> Column:
    """A list as `a|~|c`, a list of lists as `a|b;c`."""
    item = dtype.elementType
    if isinstance(item, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: joined(x, item)), ROW)
    if isinstance(item, (T.DoubleType, T.FloatType)):
        # The adapters' measures are whole numbers: print them as such.
        value = value.cast("array<bigint>")
    return F.array_join(value.cast("array<string>"), ITEM, NULL_MARK)


def plain(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        return joined(value, dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(value)
    if isinstance(dtype, T.DoubleType):
        return value.cast("bigint")
    return value


def flatten(docs: DataFrame, without: Sequence[str] = ("doc_key",)) -> DataFrame:
    """Every struct field as `<table>__<field>`; scalar lists of a regrouped asset join with `|`."""
    out = []
    for field in docs.schema.fields:
        if field.name in without:
            continue
        if isinstance(field.dataType, T.StructType):
            for inner in field.dataType.fields:
                value = F.col(field.name).getField(inner.name)
                out.append(plain(value, inner.dataType).alias(f"{field.name}__{inner.name}"))
        else:
            out.append(plain(F.col(field.name), field.dataType).alias(field.name))
    return docs.select(*out)
