"""Scoring issues as they arrive: the batch projection runs unchanged on a stream, as it keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.operators.scoring import score_issues
from quarryline.sources.readers import ISSUE


def issue_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Issues from JSON-lines files that appear in a folder."""
    rows = spark.readStream.schema(ISSUE).option("maxFilesPerTrigger", most_files).json(folder)
    return rows.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def score_stream(issues: DataFrame, now: str) -> DataFrame:
    return score_issues(issues, now)


def write_scores(scored: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scored issues as Parquet; once: what is there now, then stop."""
    writer = scored.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
