"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm import embedding_dedup as embeddings
from wellspark.llm import merkle_manifest, paragraph_sketch, phrase_mining, quality_rules
from wellspark.llm import substring_dedup as substrings
from wellspark.llm.byte_bpe import decoded, encoded
from wellspark.llm.embedding_dedup import embedding_dedup
from wellspark.llm.lattice_lm import lattice_scores
from wellspark.llm.packing import pack_documents
from wellspark.llm.sharding import sharded
from wellspark.llm.simhash import simhash_groups
from wellspark.llm.substring_dedup import substring_dedup
from wellspark.llm.toxicity import toxicity
from wellspark.llm.url_filter import url_filter

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.quality_rules(docs, carry=["doc_id"])
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(_table(spark, folder, "embeddings"), "vec_id", "embedding")


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = sharded(_table(spark, folder, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_scores(_table(spark, folder, "documents"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup(_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _table(spark, folder, "documents").select("doc_id", encoded(spark, "text").alias("ids"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(decoded(spark, "ids"), 256).alias("decoded_sha256"),
    )


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter(_table(spark, folder, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(_table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    # Tampering takes the line feeds from every text whose doc_id has an even checksum.
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle_manifest.merkle_manifest(_table(spark, folder, "documents"), altered)


def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_mining.phrases(_table(spark, folder, "documents"))


def op13_paragraph_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_sketch.compared(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_paragraph_sketch": op13_paragraph_sketch,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_embedding_dedup": embeddings.SQL,
    "op7_substring_dedup": substrings.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op12_phrase_mining": phrase_mining.SQL,
    "op13_paragraph_sketch": paragraph_sketch.SQL,
}
