"""Session settings the library is written for."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession

# UTC keeps zoneless parquet timestamps and their text forms equal on every executor.
# Joins may use a part of their keys: rows shuffled by well stay put through joins on longer keys.
# Small shuffled sides are hashed instead of sorting wide document rows; AQE checks the size.
# Generated methods beyond the JVM's limit for compiling (8,000 bytes) run interpreted, three times as long: tables of fifty columns pass it.
# Rows that are sorted by their keys are aggregated in one pass, without a partial one and its buffers.
# Rows grow wider after a shuffle than they were in it, so its partitions are not merged to more than a few MB.
# Wide rows take half the disk in shuffles and spills with zstd; it is read when a session starts, a running one keeps its own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.io.compression.codec": "zstd",
}
# Those that decide about the plans of wide documents, not about results; a running session takes them too.
PLANNING = (
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold",
    "spark.sql.requireAllClusterKeysForCoPartition",
    "spark.sql.codegen.hugeMethodLimit",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "spark.sql.execution.replaceHashWithSortAgg",
)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> None:
    """Gives a session that was made without `configure` the settings for planning that it has no value for."""
    set_already = spark.conf.getAll
    for key in PLANNING:
        if key not in set_already:
            spark.conf.set(key, SETTINGS[key])


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wellspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="wellspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs that all executors share: spark.checkpoint.dir, or one of our own in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()
