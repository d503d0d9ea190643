"""The operators on streams.  Detectors and masks are stateless projections, so the expressions are those of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect, rewrite
from ..rules import Rule, Rulepack


def read_documents(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Parquet files of a table as they arrive."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(path)


def scan_stream(targets: DataFrame, pack: Rulepack | None = None, detectors=("regex", "legal_id", "endpoint")) -> DataFrame:
    return detect.findings(targets, pack, detectors)


def scrub_stream(df: DataFrame, column: str, rule: Rule, salt: bytes) -> DataFrame:
    return df.withColumn(column, rewrite.scrub_rule(F.col(column), rule, salt))


def first_seen(df: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def category_counts(findings: DataFrame, event_time: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Findings by category in windows of event time."""
    return findings.withWatermark(event_time, delay).groupBy(F.window(event_time, width), "category").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there now, written to Parquet once; reruns go on from the checkpoint."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
