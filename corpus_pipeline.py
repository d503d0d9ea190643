"""Corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanctum.llm import mixing, packing, quality, secrets, simhash
from sanctum.llm.common import WRITTEN, by_position, materialize, positioned, read_table, row_id, sweep


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; failing lines are removed from their texts."""
    return quality.clean(docs, "text", "n_chars")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, once."""
    placed = row_id(positioned(docs), "doc_id")
    found = simhash.near_duplicates(simhash.fingerprints(placed, "__id"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return by_position(placed, kept.select("doc_id.file", "doc_id.row", F.lit(1).alias("copies")))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs, "text", "n_chars")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each repetition."""
    placed = row_id(positioned(docs), "doc_id")
    sized = mixing.sizes(placed, "__id").select("doc_id", F.array("source").alias("sources"), "size")
    mixed = mixing.mix(sized, mixing.cycle_weights, order_by="doc_id.id")
    return by_position(placed, mixed.where("copies > 0").select("doc_id.file", "doc_id.row", "copies"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("secrets", stage_secrets),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: SQL has neither the hash of the fingerprints nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), len(WRITTEN)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
            sweep(spark, WRITTEN[before:-1])  # the stage's own tables and its input
    return docs
