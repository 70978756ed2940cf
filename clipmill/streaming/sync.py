"""Project files as a stream of changes.

A change is (relative_path, text, deleted, seq): a new or changed file, or a tombstone
of one that is gone. Micro-batches go into the store by ``foreachBatch``; the last
batch that is in is written down with the store, so that a batch that comes again
after a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import sync_project
from ..sources.config import Project
from ..sources.store import Store
from ..sources.versions import Versions

CHANGE = "relative_path string, text string, deleted boolean, seq long"


def change_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Changes of JSON files as they appear in a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", most_files).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """The last change of each path; of equal numbers a tombstone counts, then the larger text."""
    known = batch.filter("relative_path IS NOT NULL").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return known.groupBy("relative_path").agg(F.max(F.struct("seq", "deleted", "text")).alias("c")).select("relative_path", "c.text", "c.deleted")


def into_project(store: Store, project: Project, now: Callable[[], str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that brings a project up to date with changes."""
    done = Versions(store.spark, f"{store.folder}/synced/{project.name}")

    def handle(batch: DataFrame, number: int) -> None:
        version, lines = done.latest()
        if lines and number <= int(lines[0]):
            return
        changes = latest(batch).persist()
        if changes.limit(1).count():
            text = F.coalesce("text", F.lit(""))
            disk = changes.filter("NOT deleted").select("relative_path", text.alias("text"), F.sha2(text, 256).alias("content_hash"))
            sync_project(store, project, disk, now(), changes)
        changes.unpersist()
        done.commit(version, [str(number)])

    return handle


def run_changes(spark: SparkSession, folder: str, store: Store, project: Project, now: Callable[[], str], checkpoint: str) -> None:
    """Take in the changes that lie in a folder, in micro-batches, and stop."""
    writer = change_stream(spark, folder).writeStream.foreachBatch(into_project(store, project, now)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
