"""Streams: clips as they arrive, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.clips import decoded
from ..sources.store import Store

CLIP = "path string, source_title string, text string, clip_date string, clip_date_source string, doctype_name string, parser string, merge_strategy string"


def clip_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """path and raw text of .txt and .md files as they appear in a folder; each file once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", "*.{txt,md}").option("maxFilesPerTrigger", most_files).load(folder).select("path", decoded(F.col("content")).alias("raw"))


def into_store(store: Store, ingest: Callable[[Store, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. A batch that is replayed changes nothing: clips whose path is stored are passed over."""

    def handle(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            ingest(store, batch)

    return handle


def run_clips(spark: SparkSession, folder: str, store: Store, ingest: Callable[[Store, DataFrame], None], checkpoint: str) -> None:
    """Take in what lies in a folder, in micro-batches, and stop."""
    writer = clip_stream(spark, folder).writeStream.foreachBatch(into_store(store, ingest)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; late rows within the watermark still count. Works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: runs of events with gaps below ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
