"""The stored tables: schemas, keys and closed domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables and their columns, the keys, and what columns may hold.
TABLES = {
    "documents": "id long, title string, source_title string, doctype_name string, merge_strategy string, origin_path string, clip_date string, document_minhash array<bigint>, project string, relative_path string, content_hash string, doc_status string, doc_role string, synced_at string, clip_date_source string, document_shingle_count long",
    "entries": "id long, document_id long, body string, author string, timestamp string, source_title string, clip_date string, file_path string, position int, heading_level int, heading_title string, is_quote boolean, minhash array<bigint>",
    "chunks": "id long, entry_id long, chunk_index int, start_char int, end_char int, body string",
    "document_tags": "document_id long, tag string",
    "derived_content": "id long, document_id long, content_type string, content string, model string, source_hash string, quality string, parent_id long, created_at string",
    "claims": "id long, document_id long, entry_id long, author string, content string, model string, prompt_hash string, created_at string",
    "document_relations": "id long, from_document_id long, to_document_id long, relation string, similarity double, shared_block_words int, resolution string, summary string, summary_model string, summary_prompt_hash string, created_at string",
    "document_families": "document_id long, family long",
    "vec_chunks": "id long, embedding array<float>",
    "vec_claims": "id long, embedding array<float>",
}
KEYS = {
    "documents": ["id"], "entries": ["id"], "chunks": ["id"], "document_tags": ["document_id", "tag"], "derived_content": ["document_id", "content_type"],
    "claims": ["id"], "document_relations": ["from_document_id", "to_document_id"], "document_families": ["document_id"], "vec_chunks": ["id"], "vec_claims": ["id"],
}
DOMAINS = {
    ("documents", "merge_strategy"): ("none", "positional", "timestamped"),
    ("documents", "clip_date_source"): ("filename", "content", "metadata", "ingest_fallback"),
    ("documents", "doc_status"): ("canonical", "provisional", "archived", "missing"),
    ("derived_content", "content_type"): ("detailed", "brief"),
    ("derived_content", "quality"): ("ok", "bad"),
    ("document_relations", "resolution"): ("superseded", "kept_both"),
}
PARENTS = {"entries": ("document_id", "documents"), "chunks": ("entry_id", "entries"), "document_tags": ("document_id", "documents"), "derived_content": ("document_id", "documents"), "claims": ("document_id", "documents"), "vec_chunks": ("id", "chunks"), "vec_claims": ("id", "claims")}


def struct(table: str) -> T.StructType:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([], TABLES[table]).schema


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns and types of a table; missing ones are null, others go."""
    cols = [part.strip().split(" ", 1) for part in TABLES[table].split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in cols])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value outside its closed domain."""
    bad = F.lit(False)
    for (name, column), allowed in DOMAINS.items():
        if name == table and column in df.columns:
            bad = bad | (F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return df.filter(bad)


def orphans(children: DataFrame, table: str, parents: DataFrame) -> DataFrame:
    """Rows whose parent is gone."""
    key, _ = PARENTS[table]
    return children.join(parents.select(F.col("id").alias(key)), key, "left_anti")
