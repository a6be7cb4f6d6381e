"""Table scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A parquet table under a root folder; columns and filters are pushed to it by Catalyst."""
    return spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet")


def scan_all(spark: SparkSession, root: str, tables: Iterable[str]) -> dict[str, DataFrame]:
    return {table: scan(spark, root, table) for table in tables}


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    bounds: tuple[int, int],
    partitions: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table, read by `partitions` parallel range queries over a numeric column; never by one task."""
    ranges = {
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **(options or {})).load()


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table; each branch is a column-free scan with a map-side count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in frames.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
