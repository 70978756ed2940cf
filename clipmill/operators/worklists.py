"""What enrichment has still to do, and counts of what it did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_bodies(entries: DataFrame, glue: str = "\n", key: str = "document_id") -> DataFrame:
    """(document_id, text): bodies by position. One document's bodies are one value, as the store keeps them."""
    return entries.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), glue).alias("text"))


def full_text(entries: DataFrame, key: str = "document_id") -> DataFrame:
    """(document_id, text) with headings and authors before bodies."""
    head = F.when(F.coalesce("heading_title", F.lit("")) != "", F.concat(F.lit("## "), F.col("heading_title"), F.lit("\n\n"))).otherwise("")
    by = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("["), F.col("author"), F.lit("]\n"))).otherwise("")
    part = F.concat(head, by, F.coalesce("body", F.lit("")), F.lit("\n\n"))
    return entries.select(key, "position", part.alias("body")).transform(lambda e: joined_bodies(e, "", key))


def yank_text(entries: DataFrame, key: str = "document_id") -> DataFrame:
    """(document_id, text) as Markdown: headings at their level, parts by blank lines."""
    level = F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1))
    head = F.when(F.col("heading_title").isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("heading_title"), F.lit("\n\n"))).otherwise("")
    return entries.select(key, "position", F.concat(head, "body").alias("body")).transform(lambda e: joined_bodies(e, "\n\n", key))


def source_hash(entries: DataFrame, key: str = "document_id") -> DataFrame:
    """(document_id, source_hash): depends on bodies and their order."""
    return joined_bodies(entries, "\x00", key).select(key, F.sha2("text", 256).alias("source_hash"))


def single_author(entries: DataFrame, key: str = "document_id") -> DataFrame:
    """(document_id, author): the author where there is exactly one, else null."""
    return entries.groupBy(key).agg(F.when(F.countDistinct("author") == 1, F.min("author")).alias("author"))


def lacking(rows: DataFrame, done: DataFrame, row_key: str, done_key: str) -> DataFrame:
    """Rows without a counterpart, such as chunks without an embedding."""
    return rows.join(done.select(F.col(done_key).alias(row_key)).distinct(), row_key, "left_anti")


def needs_extraction(documents: DataFrame, claims: DataFrame, model: str, prompt_hash: str, skip_types: tuple[str, ...] = ()) -> DataFrame:
    """Documents without a claim of this model and prompt. Those that yielded none are tried again."""
    done = claims.filter((F.col("model") == model) & (F.col("prompt_hash") == prompt_hash)).select(F.col("document_id").alias("id")).distinct()
    rows = documents.filter(~F.coalesce(F.col("doctype_name").isin(*skip_types), F.lit(False))) if skip_types else documents
    return rows.join(done, "id", "left_anti")


REASONS = ("missing", "bad_detailed", "bad_brief", "stale")


def needs_derivation(documents: DataFrame, derived: DataFrame, hashes: DataFrame | None = None, wanted: tuple[str, ...] = REASONS) -> DataFrame:
    """(id, reason, priority): missing detail, bad detail, bad brief, and stale detail where ``hashes`` are given; the first of the ``wanted`` reasons counts."""
    detailed = derived.filter("content_type = 'detailed'")
    missing = documents.join(detailed.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(1).alias("priority"))
    bad = lambda kind, p: derived.filter((F.col("content_type") == kind) & (F.col("quality") == "bad")).select(F.col("document_id").alias("id"), F.lit(p).alias("priority"))
    every = missing.unionByName(bad("detailed", 2)).unionByName(bad("brief", 3))
    if hashes is not None:
        now = hashes.select("document_id", F.col("source_hash").alias("__now"))
        every = every.unionByName(detailed.join(now, "document_id").filter(F.col("source_hash").isNull() | (F.col("source_hash") != F.col("__now"))).select(F.col("document_id").alias("id"), F.lit(4).alias("priority")))
    reason = F.element_at(F.array(*[F.lit(x) for x in REASONS]), F.col("priority"))
    every = every.filter(reason.isin(*wanted))
    return every.groupBy("id").agg(F.min("priority").alias("priority")).select("id", reason.alias("reason"), "priority")


def needs_diff(relations: DataFrame, model: str, prompt_hash: str) -> DataFrame:
    """Relations without a summary, or with one of another model or prompt."""
    return relations.filter(F.col("summary").isNull() | ~F.col("summary_model").eqNullSafe(F.lit(model)) | ~F.col("summary_prompt_hash").eqNullSafe(F.lit(prompt_hash)))


def diff_worklist(relations: DataFrame, entries: DataFrame, instructions: str) -> DataFrame:
    """``relations`` with added, removed and the prompt that asks for a summary of the change."""
    from ..functions.text import diff_prompt, diff_side

    texts = joined_bodies(entries)
    side = lambda s: texts.select(F.col("document_id").alias(f"{s}_document_id"), F.col("text").alias(f"__{s}"))
    both = relations.join(side("from"), "from_document_id").join(side("to"), "to_document_id")
    sides = both.withColumn("added", diff_side(F.col("__from"), F.col("__to"))).withColumn("removed", diff_side(F.col("__to"), F.col("__from")))
    return sides.withColumn("prompt", diff_prompt(F.col("added"), F.col("removed"), instructions)).drop("__from", "__to")


def derive_status(documents: DataFrame, derived: DataFrame) -> DataFrame:
    """One row of counters in one pass over each table; stale ones are always reported as 0."""
    kind = lambda c, q: F.count_if((F.col("content_type") == c) & (F.col("quality") == q))
    counts = derived.agg(kind("detailed", "ok").alias("detailed_ok"), kind("detailed", "bad").alias("detailed_bad"), kind("brief", "ok").alias("brief_ok"), kind("brief", "bad").alias("brief_bad"), F.lit(0).cast("bigint").alias("detailed_stale"))
    return documents.agg(F.count("*").alias("total_documents")).join(F.broadcast(counts))  # one row each


def extraction_status(documents: DataFrame, claims: DataFrame) -> DataFrame:
    done = claims.agg(F.countDistinct("document_id").alias("with_claims"), F.count("*").alias("claims"))
    total = documents.agg(F.count("*").alias("total"))
    return total.join(F.broadcast(done)).withColumn("missing", F.col("total") - F.col("with_claims"))


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    rows = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.join(F.broadcast(row))  # one row each
    return out


def entry_chunks(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, n): chunks per document; an entry without chunks counts 1 unless it is blank."""
    per = chunks.groupBy("entry_id").agg(F.count("*").alias("n"))
    joined = entries.join(per.withColumnRenamed("entry_id", "id"), "id", "left")
    n = F.coalesce("n", F.when(F.trim("body") != "", 1).otherwise(0))
    return joined.groupBy("document_id").agg(F.sum(n).alias("n"))


def short(entry: Column) -> Column:
    return F.octet_length(entry) < 50
