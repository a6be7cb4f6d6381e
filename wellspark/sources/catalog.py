"""The project catalog: one row per project, stored as versions of a parquet table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and types of the catalog columns.
MINIMAL = ("id", "name", "fs_path", "well_count")
ASSETS = (
    "completion",
    "core",
    "dst",
    "formation",
    "ip",
    "perforation",
    "production",
    "raster_log",
    "survey",
    "vector_log",
    "zone",
)
COUNTS = ("well_count", *[f"wells_with_{asset}" for asset in ASSETS])

_POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("active", T.BooleanType()),
        *[T.StructField(c, T.StringType()) for c in ("name", "fs_path", "suite")],
        *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("storage_epsg", T.IntegerType()),
        T.StructField("storage_name", T.StringType()),
        T.StructField("display_epsg", T.IntegerType()),
        T.StructField("display_name", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ("files", "directories", "bytes")],
        T.StructField("repo_mod", T.TimestampNTZType()),
        T.StructField("polygon", T.ArrayType(_POINT)),
    ]
)


def minimal(catalog: DataFrame) -> DataFrame:
    """Id, name, path and well count."""
    return catalog.select(*MINIMAL)


def get(catalog: DataFrame, ids: str | Iterable[str] | DataFrame, key: str = "id") -> DataFrame:
    """Rows by one id, a few ids, or a table of ids."""
    if isinstance(ids, DataFrame):
        return catalog.join(ids.select(key), key, "left_semi")
    if isinstance(ids, str):
        return catalog.filter(F.col(key) == ids).limit(1)
    return catalog.filter(F.col(key).isin(list(ids)))


def ids(catalog: DataFrame, key: str = "id") -> DataFrame:
    return catalog.select(key)


def require(catalog: DataFrame, project_id: str, key: str = "id") -> str:
    """The id, or ValueError when the catalog does not have it."""
    if get(catalog, project_id, key).isEmpty():
        raise ValueError(f"unknown project id: {project_id}")
    return project_id


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", latest: str | None = None) -> DataFrame:
    """One row per key: of the updates if they have the key, else of the base.

    Of several updates with one key the one with the greatest `latest` counts, then the one with the greatest
    columns in their order. Both sides are read once."""
    both = base.withColumn("_update", F.lit(False)).unionByName(updates.withColumn("_update", F.lit(True)))
    lead = ["_update", *([latest] if latest else [])]
    best = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(lead)], *base.columns)).alias("_row")
    return both.groupBy(F.col(key).alias("_key")).agg(best).select("_row.*").drop("_o1").withColumnRenamed("_o0", "_update")


class Catalog:
    """Catalog versions in one folder, for any number of readers and writers.

    A writer reads the newest version, writes the next one under a name of its own, and renames it to the next number. Where
    another writer has taken that number meanwhile, it starts again from the other's version with the updates it has
    stored: no update is lost, and the later one counts. Readers see whole versions only; a job lost midway leaves its own
    folder behind and nothing else.

    Taking a number is as safe as the store's rename onto a name that must not exist: atomic on HDFS, checked first and then
    renamed on a local disk, not enough on object stores without one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str = ""):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, whole: bool = True) -> list[int]:
        """Numbers of the versions; with `whole` only those that count."""
        files = self._files()
        if not files.exists(self._path()):
            return []
        found = []
        for status in files.listStatus(self._path()):
            name = status.getPath().getName()
            done = self._hadoop.Path(status.getPath(), "_SUCCESS")
            if name.startswith("version=") and (not whole or files.exists(done)):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def _rows(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], SCHEMA).withColumn("_update", F.lit(False))
        return self.spark.read.parquet(f"{self.folder}/version={version}")

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or the one with this number; an empty table while there is none."""
        return self._rows(version or max(self.versions(), default=None)).drop("_update")

    def _take(self, name: str, version: int) -> bool:
        """Make the folder `name` this version; False if the number is taken."""
        path = self._files().makeQualified(self._path())
        context = self._hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._hadoop.Path(path, name), self._hadoop.Path(path, f"version={version}"), plain)
        except Py4JJavaError as failure:
            if not failure.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            return False
        return True

    def upsert(self, updates: DataFrame, attempts: int = 20) -> DataFrame:
        """Write the next version and return the upserted rows as stored; `updates` is evaluated once.

        RuntimeError if other writers are faster `attempts` times running."""
        updates, pending = updates.select(*SCHEMA.fieldNames()), None
        for _ in range(attempts):
            # In this order: a version that comes in between is seen as a number taken.
            following = max(self.versions(whole=False), default=0) + 1
            base = self._rows(max((v for v in self.versions() if v < following), default=None))
            mine = f"pending-{uuid.uuid4().hex}"
            upsert(base.drop("_update"), updates, latest="repo_mod").write.parquet(f"{self.folder}/{mine}")
            if pending:
                self._files().delete(self._path(pending), True)
            if self._take(mine, following):
                return self.spark.read.parquet(f"{self.folder}/version={following}").where("_update").drop("_update")
            pending = mine
            updates = self.spark.read.parquet(f"{self.folder}/{mine}").where("_update").drop("_update")
        raise RuntimeError(f"{attempts} times another writer was faster")

    def expire(self, keep: int) -> list[int]:
        """Delete all versions but the newest `keep` (at least one) and return their numbers; readers of those fail."""
        if keep < 1:
            raise ValueError("the newest version stays")
        gone = self.versions()[:-keep]
        for version in gone:
            self._files().delete(self._path(f"version={version}"), True)
        return gone
