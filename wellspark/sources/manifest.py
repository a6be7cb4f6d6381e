"""Projects, storage totals and modification times from a file manifest (path, is_dir, length, mtime)."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.text import normal_path
from wellspark.functions.values import floor_second
from wellspark.session import shared_folder

# Fixed file names: what makes a directory a project, and what a mere connection touches.
DATABASE_FILES = ("gxdb.db", "gxdb_production.db")
AREA_FOLDERS = ("Global",)
VOLATILE_FILES = ("gxdb.db", "gxdb_production.db", "gxdb.log")


@dataclass(frozen=True)
class Markers:
    """Names a project directory has to hold directly, as files and as folders."""

    files: Sequence[str] = DATABASE_FILES
    folders: Sequence[str] = AREA_FOLDERS
    volatile: Sequence[str] = VOLATILE_FILES


MANIFEST = "path string, is_dir boolean, length bigint, mtime timestamp_ntz"
# Folders that one task lists, about, and the entries of a folder that leave it at once.
FOLDERS, ENTRIES = 64, 10_000


def _local_entries(folder: str) -> Iterator[tuple]:
    """What a folder of a mounted file system holds, hidden names too. Links are not followed: they may lead back."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.path, True, 0, None
                    else:
                        about = entry.stat(follow_symlinks=False)
                        yield entry.path, False, about.st_size, int(about.st_mtime * 1_000_000)
                except FileNotFoundError:
                    continue  # gone meanwhile
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return


def _remote_entries(folder: str) -> Iterator[tuple]:
    """The same of a folder in a store that has a URI."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(folder)
    lead = folder[: len(folder) - len(inside)] if folder.endswith(inside) else folder.split("://")[0] + "://"
    for entry in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        if entry.type == fs.FileType.Directory:
            yield lead + entry.path, True, 0, None
        else:
            yield lead + entry.path, False, entry.size or 0, entry.mtime_ns and entry.mtime_ns // 1000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder; no more than ENTRIES are held at once."""
    names, kinds = ["path", "is_dir", "length", "mtime"], [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us")]
    for batch in batches:
        for folder in batch["path"].to_pylist():
            entries = _remote_entries(folder) if "://" in folder else _local_entries(folder)
            while part := list(islice(entries, ENTRIES)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)


def read_manifest(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """Files and folders at and below a root with size and time, empty folders and hidden names too; contents are not read.

    The tree is listed level by level: the folders of a level are dealt over the executors, which list them and write what
    they find below `folder` (default: the session's shared folder); the folders among it are the next level. The
    driver learns only how many there are, and as many jobs run as the tree is deep. A path without a scheme, or with
    `file:`, has to be mounted on all executors. Links count as files and are not followed; folders that vanish or
    may not be read are listed without what they hold. A root that is not there gives its own row only."""
    start = re.sub("^file:/*", "/", root).rstrip("/") or "/"
    base = f"{(folder or shared_folder(spark)).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    level, depth = spark.createDataFrame([(start, True, 0, None)], MANIFEST), 0
    while True:
        level.write.parquet(f"{base}/{depth}")
        level = spark.read.schema(MANIFEST).parquet(f"{base}/{depth}")
        waiting = level.where("is_dir").select("path")
        count = waiting.count()
        if not count:
            break
        # Dealt by hash, so the folders of one parent go to many tasks.
        level = waiting.repartition(-(-count // FOLDERS), "path").mapInArrow(_listed, MANIFEST)
        depth += 1
    return spark.read.schema(MANIFEST).parquet(*(f"{base}/{d}" for d in range(depth + 1)))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _ancestors(path: Column) -> Column:
    """Every folder above a path, as an array."""
    parts = F.split(path, "/")
    depths = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folders(manifest: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """One row per folder: bytes and files it holds directly, their latest time, and whether it is a project.

    The manifest is read once and combined before the shuffle, so a huge folder costs one row per task. A marker
    folder marks the one above it."""
    path = normal_path(F.col("path"))
    name = _name(path)
    is_file = ~F.col("is_dir")
    none = F.lit(None).cast("string")
    own = F.struct(
        F.when(F.col("is_dir"), path).otherwise(_parent(path)).alias("folder"),
        F.lit(True).alias("listed"),
        F.when(is_file & name.isin(list(markers.files)), F.concat(F.lit("file "), name)).otherwise(none).alias("mark"),
    )
    above = F.struct(_parent(path).alias("folder"), F.lit(False).alias("listed"), F.concat(F.lit("folder "), name).alias("mark"))
    parts = F.when(F.col("is_dir") & name.isin(list(markers.folders)), F.array(own, above)).otherwise(F.array(own))
    counts = F.when(is_file & ~name.isin(list(markers.volatile)), F.col("mtime").cast("timestamp_ntz"))
    rows = manifest.select("is_dir", "length", counts.alias("mtime"), F.explode(parts).alias("_f"))
    listed = F.col("_f.listed") & ~F.col("is_dir")
    marks = [f"file {f}" for f in markers.files] + [f"folder {f}" for f in markers.folders]
    whole = [F.coalesce(F.bool_or(F.col("_f.mark") == m), F.lit(False)) for m in marks]
    project = whole[0]
    for mark in whole[1:]:
        project = project & mark
    return rows.groupBy(F.col("_f.folder").alias("folder")).agg(
        F.sum(F.when(listed, F.col("length"))).alias("bytes"),
        F.count_if(listed).alias("files"),
        F.max(F.when(listed, F.col("mtime"))).alias("mtime"),
        F.bool_or("_f.listed").alias("listed"),
        project.alias("is_project"),
    )


def find_projects(manifest: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """Distinct directories that directly hold every marker file and folder."""
    return folders(manifest, markers).where("is_project").select(F.col("folder").alias("fs_path"))


def project_totals(manifest: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """project_root, bytes, files, directories and repo_mod (latest time of a file that is not volatile; 1970-01-01
    without one) of every project.

    Every folder is counted for each project at or above it, by equality on its ancestors: folders, not files, are
    multiplied, and only as often as they are deep."""
    each = folders(manifest, markers)
    roots = each.where("is_project").select(F.col("folder").alias("project_root"))
    # The ancestors of a path below a folder are the folder and all above it; the empty one is no folder.
    above = F.filter(_ancestors(F.concat("folder", F.lit("/"))), lambda p: p != "")
    owned = each.where("listed").withColumn("project_root", F.explode(above)).join(roots, "project_root")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    out = owned.groupBy("project_root").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.sum("files").alias("files"),
        F.count(F.lit(1)).alias("directories"),
        F.greatest(F.coalesce(F.max("mtime"), epoch), epoch).alias("repo_mod"),
    )
    return out.withColumn("repo_mod", floor_second(F.col("repo_mod"), out.schema["repo_mod"].dataType))
