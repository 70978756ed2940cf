"""Cosine search over embedding columns."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Filters, author_contains, dates, without_tags

if TYPE_CHECKING:
    from .vector_index import VectorIndex

OVERFETCH = 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 where a norm is 0 or a vector is missing."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.coalesce(F.when(norms > 0, dot(x, y) / norms), F.lit(0.0))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id") -> DataFrame:
    """The k nearest (id, similarity); ties go to the smaller id. Top-k per task, then of those."""
    scored = vectors.select(id_col, cosine(F.col("embedding"), vector(query)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def search(chunks: DataFrame, vectors: DataFrame, tags: DataFrame, query: list[float], limit: int, filters: Filters | None = None, mode: str = "overfetch", index: VectorIndex | None = None) -> DataFrame:
    """Nearest chunks with their columns.

    ``overfetch``: k nearest first (five times as many with a filter), then the
    filters, so fewer than ``limit`` may stay. ``exact``, and any search in a
    project, filters first and ranks what is left. With ``index`` the nearest come
    from it; filters that go first then hide all other ids from it.
    """
    filters = filters or Filters()

    def after(df: DataFrame) -> DataFrame:
        df = df.filter(author_contains(F.col("author"), filters.author)) if filters.author else df
        return without_tags(dates(df, filters), tags, filters.excluded_tags)

    if filters.project or mode == "exact":
        kept = after(chunks.filter(F.col("project") == filters.project) if filters.project else chunks)
        if index is not None:
            near = index.search(query, limit * OVERFETCH, allowed=kept.select(F.col("chunk_id").alias("id"))).withColumnRenamed("id", "chunk_id")
            return suppress_overlaps(kept.join(F.broadcast(near), "chunk_id")).orderBy(F.desc("similarity"), "chunk_id").limit(limit)  # overlaps cost at most some of the rows fetched beyond the limit
        hits = kept.join(vectors.select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id").withColumn("similarity", cosine(F.col("embedding"), vector(query))).drop("embedding")
    else:
        k = limit * OVERFETCH if filters.any_after_search else limit
        near = (knn(vectors, query, k) if index is None else index.search(query, k)).withColumnRenamed("id", "chunk_id")
        hits = after(chunks.join(F.broadcast(near), "chunk_id"))  # k rows
    return suppress_overlaps(hits).orderBy(F.desc("similarity"), "chunk_id").limit(limit)


def suppress_overlaps(hits: DataFrame, group: tuple[str, ...] = ("document_id", "entry_position"), start: str = "start_char", end: str = "end_char") -> DataFrame:
    """In each group, from the most similar on, drop hits whose span overlaps a kept one (half-open spans)."""
    row = F.struct((-F.col("similarity")).alias("__s"), F.col("chunk_id").alias("__c"), F.col(start).alias("__a"), F.col(end).alias("__b"))
    folded = hits.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    empty = F.slice(F.col("__rows"), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: (k["__a"] < x["__b"]) & (x["__a"] < k["__b"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    kept = folded.select(F.explode(F.aggregate("__rows", empty, step)).alias("k")).select(F.col("k.__c").alias("chunk_id"))
    return hits.join(kept, "chunk_id", "left_semi")


def claims(claim_rows: DataFrame, vectors: DataFrame, tags: DataFrame, query: list[float], limit: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Nearest claims whose document has none of the tags; five times as many are fetched then."""
    near = knn(vectors, query, limit * OVERFETCH if excluded else limit).withColumnRenamed("id", "claim_id")
    hits = claim_rows.join(F.broadcast(near), "claim_id")
    return without_tags(hits, tags, excluded).orderBy(F.desc("similarity"), "claim_id").limit(limit)
