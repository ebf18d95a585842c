"""Incremental indexing of commits that arrive as files, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegrain.operators.ignore import Layers
from tracegrain.plans.index import Index

ARRIVING = "commit_sha string, parent_sha string, is_merge boolean, author string, ts long, message string, hunks array<struct<file_path: string, language: string, change_kind: string, diff_text: string>>"


def follow(spark: SparkSession, incoming: str, index: Index, checkpoint: str, layers: Layers | None = None, files_at_once: int = 100) -> StreamingQuery:
    """Index parquet files of commits as they come.

    The checkpoint is the bookmark.  A batch that is tried again finds its
    commits known or replaces their rows, so each has its effect once; one that
    fails stops the query, and no commit is skipped.  files_at_once bounds a
    batch.
    """

    def one(batch: DataFrame, _: int) -> None:
        commits = batch.drop("hunks")
        hunks = batch.select("commit_sha", F.explode("hunks").alias("h")).select("commit_sha", "h.*")
        index.ingest(commits, hunks, layers)

    arriving = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_at_once).parquet(incoming)
    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type in windows of time, closed when events as late as `late` can no longer come."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
