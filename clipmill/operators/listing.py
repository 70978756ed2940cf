"""Listings, dumps and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SORTS = {"source": "source_title", "doctype": "doctype_name", "date": "clip_date"}


def list_documents(documents: DataFrame, entries: DataFrame, chunks: DataFrame, tags: DataFrame, derived: DataFrame) -> DataFrame:
    """One row per document: counts, tags joined by commas, a first line and a brief. Children are summed before they are joined."""
    per_entry = chunks.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("n"))
    e = entries.join(per_entry, "id", "left")
    first = F.min_by(F.substring("body", 1, 100), F.when(F.trim("body") != "", F.col("position")))
    per_doc = e.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("entry_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), first.alias("first_line"))
    tag_list = tags.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    brief = derived.filter("content_type = 'brief' AND quality = 'ok'").select(F.col("document_id").alias("id"), F.substring("content", 1, 200).alias("brief"))
    rows = documents.join(per_doc, "id", "left").join(tag_list, "id", "left").join(brief, "id", "left")
    return rows.withColumn("entry_count", F.coalesce("entry_count", F.lit(0))).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def sort_listing(rows: DataFrame, by: str, descending: bool) -> DataFrame:
    """Nulls come last both ways; ids settle ties."""
    c = F.col(SORTS[by])
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id")


def dump(documents: DataFrame, entries: DataFrame, title: str | None = None) -> DataFrame:
    """Documents with their entries, by title part (ASCII case doesn't matter); documents without entries are left out."""
    from .filters import author_like

    kept = documents.filter(author_like(F.col("source_title"), title)) if title else documents
    return kept.withColumnRenamed("id", "document_id").join(entries.select("document_id", "position", "author", "heading_title", "body"), "document_id")


def nested(documents: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """A document per row with entries in order, each with its chunks in order."""
    c = chunks.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "start_char", "end_char", "body"))).alias("chunks"))
    e = entries.join(c, entries["id"] == c["entry_id"], "left")
    e = e.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "author", "heading_title", "body", "chunks"))).alias("entries"))
    return documents.join(e, documents["id"] == e["document_id"], "left").drop("document_id")


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n_documents"))


def title_groups(documents: DataFrame) -> DataFrame:
    """Documents with their group, and the next and previous of it, round the end."""
    from ..functions.text import group_key

    from .neighbours import neighbours

    keyed = documents.withColumn("group_key", group_key(F.col("source_title"))).filter("group_key IS NOT NULL")
    near = neighbours(keyed, ["group_key"], ["clip_date"])
    place = F.struct("clip_date", "id")
    ends = keyed.groupBy("group_key").agg(F.min(place).id.alias("first"), F.max(place).id.alias("last"))
    # Only the two ends of a group look up where it begins and ends.
    edge = F.when(F.col("next_id").isNull() | F.col("previous_id").isNull(), F.col("group_key")).alias("edge")
    joined = near.select("*", edge).join(ends.withColumnRenamed("group_key", "edge"), "edge", "left")
    return joined.select(*keyed.columns, F.coalesce("next_id", "first").alias("next_id"), F.coalesce("previous_id", "last").alias("previous_id"))


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; missing values are left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
