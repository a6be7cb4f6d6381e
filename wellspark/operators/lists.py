"""Ordered, null-keeping list aggregation.

One `collect_list` of a struct per child table keeps every list of a group in the same row
order and keeps null elements; one sort of that array orders them all. A group is one row at any
size; for groups too wide for a row, take the long form (`Recipe.items`) by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _order_names(order: Sequence[str]) -> list[str]:
    return [f"_order{i}" for i in range(len(order))]


def first_non_null(items: Column, name: str) -> Column:
    """The first non-null `name` among gathered items, by their field `_rank`; equal ranks take the smallest value."""
    known = F.filter(items, lambda x: x[name].isNotNull())
    ranked = F.transform(known, lambda x: F.struct(x["_rank"], x[name].alias("_value")))
    return F.array_min(ranked)["_value"]


@dataclass(frozen=True)
class Gathered:
    """One row per group with its rows in the column `items`, and the lists to take out of it.

    A join moves one column of items cheaper than the lists, so they are spread behind it.
    """

    rows: DataFrame
    items: str
    lists: Mapping[str, Column]

    def spread(self, df: DataFrame | None = None) -> DataFrame:
        """The lists in place of the items, of these rows or of others that the items were joined to."""
        df = self.rows if df is None else df
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c != self.items], *[v.alias(n) for n, v in self.lists.items()])

    def fill_empty(self, df: DataFrame) -> DataFrame:
        """A missing side of a left join: without items."""
        return df.withColumn(self.items, empty_list(df.schema[self.items]))


# Types that take eight bytes a value in a row, in the order in which their columns are laid out.
FIXED_WIDTH = ("timestamp", "timestamp_ntz", "date", "boolean", "double", "float", "bigint", "int", "smallint", "tinyint")


def by_type(df: DataFrame) -> DataFrame:
    """The same columns, those of a type side by side: texts and nested ones first.

    Rows are shuffled as they lie and compressed some fifty at once if they are wide. Places of texts, nulls and zeros
    of neighbouring rows meet in longer runs then, which shrinks a shuffle by a sixth or more. Who needs the columns' order
    restores it behind the shuffle. Names that are not unique stay as they are.
    """
    if len({c.lower() for c in df.columns}) < len(df.columns):
        return df
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = sorted(df.columns, key=lambda c: FIXED_WIDTH.index(kinds[c]) if kinds[c] in FIXED_WIDTH else -1)
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])


def gather(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column] | Sequence[str],
    constants: Mapping[str, Column] | None = None,
    firsts: Sequence[str] = (),
    extra: Sequence[Column] = (),
    partition_by: Sequence[str] | None = None,
    items: str = "_items",
) -> Gathered:
    """One array per value and group, all in the order of `order`, then of the values themselves.

    `values` maps list names to expressions over the rows. `constants` maps list names to
    expressions over the keys: the same in every item, they are repeated instead of gathered.
    `firsts` are columns of which the first non-null in that order is kept; `extra` are ordinary
    aggregates computed along. `partition_by` are the columns to shuffle by, a subset of
    the keys; empty when the rows already lie together.

    Rows are shuffled before they are gathered: gathering shrinks nothing, so a map-side pass
    would only cost memory, and the value expressions run after the shuffle, in even partitions.
    They are sorted by the keys, so that a group is gathered once, while it passes (see session.py).
    """
    if not isinstance(values, Mapping):
        values = {name: F.col(name) for name in values}
    constants = constants or {}
    partition_by = list(keys) if partition_by is None else list(partition_by)
    rows = by_type(df).repartition(*partition_by) if partition_by else df
    item = [F.col(c).alias(o) for c, o in zip(order, _order_names(order))]
    item += [value.alias(name) for name, value in values.items()]
    field = F.col(items)
    ranked = field
    if firsts:
        item = [F.struct(*item).alias("_rank"), *[F.col(c) for c in firsts]]
        ranked = field.getField("_rank")
    # The item is a column of its own before it is gathered: an aggregate's argument would be interpreted.
    rows = rows.withColumn(items, F.struct(*item)).sortWithinPartitions(*keys)
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(items)).alias("_sorted"), *extra)
    kept = [c for c in gathered.columns if c not in keys and c != "_sorted"]
    lists = {name: first_non_null(field, name) for name in firsts}
    lists |= {name: ranked.getField(name) for name in values}
    lists |= {name: F.array_repeat(value, F.size(field)) for name, value in constants.items()}
    return Gathered(gathered.select(*keys, *kept, F.col("_sorted").alias(items)), items, lists)


def fold_lists(df: DataFrame, *args, **options) -> DataFrame:
    """`gather`, its lists spread."""
    return gather(df, *args, **options).spread()


def ordered_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """fold_lists over plain columns."""
    return fold_lists(df, keys, order, cols)


def empty_list(field: T.StructField) -> Column:
    """A missing list side of a left join: null becomes an empty array."""
    return F.coalesce(F.col(field.name), F.array().cast(field.dataType)).alias(field.name)
