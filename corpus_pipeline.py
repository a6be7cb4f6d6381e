"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm.common import shared_folder, stored
from wellspark.llm.packing import pack_documents
from wellspark.llm.quality_rules import quality_rules
from wellspark.llm.simhash import simhash_groups
from wellspark.llm.substring_dedup import substring_dedup
from wellspark.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE = 3
DISTANCE = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside the fences of their language and source.

    Null and empty texts fail; texts are read whole at any length; null languages and sources are groups of their own; rows
    at a fence stay; repeated rows are judged alike; an empty table gives an empty one; other columns are dropped."""
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labels of the documents here, does not call toxic.

    Null and empty texts are scored like texts without a toxic clause; texts are read whole at any length; a score of 0.5 goes;
    repeated rows and rows of one id are scored by their texts; an empty table gives an empty one; other columns
    are dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs.select(*COLUMNS), labels).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints of three-word shingles link at 3 bits or fewer one row: that with the smallest
    doc_id, a null one last, of rows with equal ids that with the smallest hash of its text.

    Null and empty texts are one group; texts are read whole at any length; of repeated rows one stays; an empty table gives
    an empty one; other columns are dropped."""
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = simhash_groups(rows, size=SHINGLE, distance=DISTANCE, row="row")
    return rows.join(groups.where("NOT kept").select("row"), "row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds; texts that lose nothing stay as they are.

    Null and empty texts stay; texts are read whole at any length; rows of one doc_id, repeated ones too, take nothing from each
    other, and rows without an id come last; an empty table gives an empty one; other columns are dropped."""
    cut = substring_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": size}).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place.

    Null and empty texts are one token, the end; longer ones than a sequence are cut; equal lengths are placed in any order;
    repeated rows are packed each; an empty table gives an empty one; other columns are not read."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packing),
]
# Toxicity, SimHash and tokens are not expressible in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; every result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
