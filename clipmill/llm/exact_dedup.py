"""Exact de-duplication with a heavy-hitter split.

1. One pass over the texts leaves a narrow, checkpointed table of digests.
2. A Misra-Gries summary (Spark's frequent-items sketch, a Misra-Gries counter
   table with median purge) per group of partitions, then merged, proposes the
   frequent digests.
3. Their groups are counted exactly (map-side partial sums) and at most
   ``frequent`` verified winners are broadcast, so rows of hot groups are decided
   where they lie, without a shuffle.
4. All other digests take an ordinary shuffle: groups are counted with map-side
   partial sums into a written table, which is joined to the rows by two plain
   exchanges, so that a group that just missed being a winner can be split.

The sketch only steers rows between two exact paths; it can't change a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SKETCHES = 64


def frequent_hashes(digests: DataFrame, frequent: int) -> DataFrame:
    """At most ``frequent`` candidate values of column ``h`` (long)."""
    tracked = 4 * frequent
    partial = digests.groupBy((F.spark_partition_id() % SKETCHES).alias("lane")).agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("sketch"))
    # Grouped by a constant: a global aggregate would also merge the empty buffers of empty partitions, which fails.
    merged = partial.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    top = merged.select(F.expr(f"approx_top_k_estimate(sketch, {frequent})").alias("top"))
    return top.select(F.explode("top").alias("t")).filter("t.count > 1").select(F.col("t.item").alias("h"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical, null counting as empty. The
    row with the largest id stays; a null id is below every other; of rows that
    repeat the largest id exactly one stays. An empty table gives no rows, and
    other columns of the input are not touched.
    """
    digests = cut(
        df.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
        .withColumn("h", F.xxhash64("text_sha256"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    best = F.max(F.struct("doc_id", "uid"))
    winners = cut(
        digests.join(F.broadcast(frequent_hashes(digests, frequent)), "h", "left_semi")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    hot = marked.filter(F.col("best").isNotNull())
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = cut(rest.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")))
    rest = rest.join(groups, "text_sha256")
    return hot.unionByName(rest.select(*hot.columns)).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256"
    )


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
