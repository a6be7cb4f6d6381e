"""What the operators share: tables in the shared folder, word rules, local components."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# The six white-space characters that end a word, and A-Z to a-z for bytes.
SPACE = "[\\x20\\x09-\\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="wellspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage and survives lost executors.

    The folder is left to its owner to empty, because lazy results still read from it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Remembered(dict):
    """key -> made(key), kept in two generations of at most `most` keys, so memory is bounded and frequent keys stay."""

    def __init__(self, most: int, longest: int):
        super().__init__()
        self.most, self.longest, self.older = most, longest, {}

    def made(self, key: bytes) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= self.longest:
            self[key] = value
        return value


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 of one task: the smallest node that each one reaches over the given links."""
    root = np.arange(n)
    while left.size:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root
