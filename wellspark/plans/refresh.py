"""Incremental exports: which wells changed since the last one, and the last one's documents brought up to date."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.plans.recipes import WELL_ID, Recipe, Tables

CHANGED = "row_changed_date"


def _state(df: DataFrame) -> list[Column]:
    """Rows and latest change: an insert and a delete move the first, an update the second."""
    date = F.max(CHANGED).cast("string") if CHANGED in df.columns else F.lit(None).cast("string")
    return [F.count(F.lit(1)).alias("rows"), date.alias("changed")]


def signatures(tables: Tables) -> DataFrame:
    """scope, uwi and signature of every well that has a row in any of the tables.

    A well's signature is a hash over its number of rows and latest `row_changed_date` in each table. Only these two are
    shuffled, combined before the shuffle, so a well with a third of all rows costs one row per task. Tables
    without wells (dictionaries) count for every well: a change in one changes all signatures. In a table without dates
    updates go unseen. Rows without a well belong to no document and are left out."""
    parts, common = [], []
    for name in sorted(tables.frames):
        key = WELL_ID.get(name, "uwi")
        if key is None:
            common.append(tables.frames[name].agg(*_state(tables.frames[name])).first())
            continue
        rows = tables.get(name).where(F.col(key).isNotNull())
        found = rows.groupBy(*tables.scope, F.col(key).alias("uwi")).agg(*_state(rows))
        parts.append(found.select(*tables.keys("uwi"), F.struct(F.lit(name).alias("table"), "rows", "changed").alias("state")))
    states = reduce(DataFrame.unionByName, parts).groupBy(*tables.keys("uwi")).agg(F.array_sort(F.collect_list("state")).alias("states"))
    dictionaries = F.lit(str([tuple(c) for c in common]))
    return states.select(*tables.keys("uwi"), F.sha2(F.concat_ws("|", F.to_json("states"), dictionaries), 256).alias("signature"))


def changes(before: DataFrame, now: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, uwi and change (`new`, `changed` or `deleted`) of the wells whose signatures differ."""
    keys = [*scope, "uwi"]
    both = before.withColumnRenamed("signature", "_before").join(now.withColumnRenamed("signature", "_now"), keys, "full")
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "deleted")
    change = change.when(F.col("_before") != F.col("_now"), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def refreshed(recipe: Recipe, tables: Tables, last: DataFrame, changed: DataFrame) -> DataFrame:
    """All documents of the asset as a full build would give them, from the `last` ones (with doc_key) and the changed wells.

    Documents of changed and deleted wells are taken from the last export; those of changed and new wells are built
    from the tables, restricted to these wells at the scan. Nothing is gathered: wells are joined, not collected."""
    if tables.ids is not None:
        raise ValueError("the tables are restricted to the changed wells: give them without ids")
    keys = tables.keys("uwi")
    fresh = recipe.build(replace(tables, ids=changed.where("change <> 'deleted'").select(*keys)))
    kept = last.withColumn("uwi", F.col("doc_key.uwi")).join(changed.select(*keys), keys, "left_anti").drop("uwi")
    return kept.select(*fresh.columns).unionByName(fresh)
