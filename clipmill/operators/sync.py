"""Curated project documents against what is on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(project, relative_path, id, content_hash, category): new, updated, unchanged or missing.

    ``disk`` is (project, relative_path, content_hash) of files that a rule fits;
    ``stored`` is (id, project, relative_path, content_hash). A file that is on
    disk without a rule must be passed as ``disk`` with a null hash: it is not
    missing, and in no category.
    """
    d = disk.select("project", "relative_path", F.col("content_hash").alias("disk_hash"), F.lit(True).alias("on_disk"))
    both = d.join(stored, ["project", "relative_path"], "full_outer")
    category = (
        F.when(F.col("on_disk").isNull(), "missing").when(F.col("disk_hash").isNull(), F.lit(None).cast("string")).when(F.col("id").isNull(), "new")
        .when(F.col("disk_hash") != F.coalesce("content_hash", F.lit("")), "updated").otherwise("unchanged")
    )
    return both.select("project", "relative_path", "id", F.coalesce("disk_hash", "content_hash").alias("content_hash"), category.alias("category")).filter("category IS NOT NULL")


def summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("project", "category").agg(F.count("*").alias("n"))
