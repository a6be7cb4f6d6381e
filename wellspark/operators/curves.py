"""Curve samples and depth registrations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.functions.binary import decode_curve, depth_points


def curve_samples(
    curves: DataFrame, blob: str, keys: Sequence[str], top: str | None = None, step: str | None = None
) -> DataFrame:
    """One row per sample: its index, value and, given top and step columns, its depth."""
    carried = [*keys, *[c for c in (top, step) if c]]
    rows = curves.select(*carried, F.posexplode(decode_curve(F.col(blob))).alias("sample", "value"))
    rows = rows.withColumn("value", F.col("value").cast("double"))
    if top and step:
        rows = rows.withColumn("depth", F.col(top) + F.col("sample") * F.col(step)).drop(top, step)
    return rows


def curve_stats(curves: DataFrame, blob: str, keys: Sequence[str]) -> DataFrame:
    """Samples, minimum, maximum and mean per curve key; NaN samples are not counted.

    Each blob is reduced to four numbers before the shuffle, so a curve split over many rows
    combines map-side and no samples move.
    """
    values = F.filter(decode_curve(F.col(blob)), lambda x: ~F.isnan(x))
    partial = curves.select(*keys, values.alias("_values")).select(
        *keys,
        F.size("_values").alias("_n"),
        F.array_min("_values").alias("_min"),
        F.array_max("_values").alias("_max"),
        F.aggregate("_values", F.lit(0.0), lambda total, x: total + x.cast("double")).alias("_sum"),
    )
    return partial.groupBy(*keys).agg(
        F.sum("_n").alias("samples"),
        F.min("_min").cast("double").alias("min_value"),
        F.max("_max").cast("double").alias("max_value"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_value"),
    )


def depth_registration(rows: DataFrame, blob: str, keys: Sequence[str]) -> DataFrame:
    """One row per registered (depth, pixel) point."""
    return rows.select(
        *keys, F.posexplode(depth_points(F.col(blob))).alias("point", "_p")
    ).select(*keys, "point", "_p.depth", "_p.pixel")
