"""The library's tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hours_after(column: str) -> F.Column:
    """A clip date that many hours after the start of 2024, as a string."""
    return F.expr(f"date_format(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast({column} as int), 0, 0), 'yyyy-MM-dd HH:mm:ss')")


def days_after(column: str, days: int = 7) -> F.Column:
    return F.expr(f"date_format(TIMESTAMP_NTZ'2000-01-01 00:00:00' + make_dt_interval(cast({column} * {days} as int), 0, 0, 0), 'yyyy-MM-dd HH:mm:ss')")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Captured documents: one entry each, source and language as title."""
    d = spread(table(spark, sf, "documents"))
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("source_title"), F.col("lang").alias("doctype_name"), F.lit("none").alias("merge_strategy"), hours_after("doc_id").alias("clip_date"), "text", "source")


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents are junk, those of low quality archived."""
    rows = table(spark, sf, "labels")
    return rows.filter("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("junk").alias("tag")).unionByName(rows.filter("quality = 0").select(F.col("doc_id").alias("document_id"), F.lit("archived").alias("tag")))


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct().select("id", F.concat(F.lit("thread "), F.col("id") % 7).alias("source_title"), F.lit("slack").alias("doctype_name"), hours_after("id").alias("clip_date"), F.when(F.col("id") % 5 == 0, "provisional").when(F.col("id") % 7 == 0, "archived").alias("doc_status"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as entries with one chunk each."""
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("conv_id").alias("document_id"),
        F.col("turn").cast("int").alias("entry_position"), F.lit(0).alias("chunk_index"), F.col("role").alias("author"), F.col("text").alias("body"),
        hours_after("conv_id").alias("clip_date"), F.concat(F.lit("thread "), F.col("conv_id") % 7).alias("source_title"), F.lit(None).cast("string").alias("heading_title"),
        F.when(F.col("conv_id") % 5 == 0, "provisional").when(F.col("conv_id") % 7 == 0, "archived").alias("doc_status"), F.concat(F.lit("p"), F.col("conv_id") % 3).alias("project"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk for each vector; four to a document, spans side by side."""
    v = table(spark, sf, "embeddings")
    return v.select(
        F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 4).cast("bigint").alias("document_id"), F.lit(0).alias("entry_position"), (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        ((F.col("vec_id") % 4) * 100).cast("int").alias("start_char"), ((F.col("vec_id") % 4) * 100 + 100).cast("int").alias("end_char"), F.concat(F.lit("role "), F.col("label")).alias("author"),
        hours_after("floor(vec_id / 4)").alias("clip_date"), F.concat(F.lit("p"), F.col("label") % 3).alias("project"), F.concat(F.lit("body "), F.col("vec_id")).alias("body"),
        F.concat(F.lit("doc "), F.floor(F.col("vec_id") / 4)).alias("source_title"), F.when(F.col("label") % 4 == 0, "archived").alias("doc_status"),
    )
