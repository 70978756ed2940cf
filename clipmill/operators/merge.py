"""Growing threads: overlap with what is stored, and what to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

MERGE_BYTES = 150


def overlaps(stored: DataFrame, new: DataFrame, least: int = MERGE_BYTES) -> DataFrame:
    """(new_doc, document_id, new_start, run_length, run_bytes): the longest run, by bytes of new bodies, that both have.

    ``stored`` has merge_key, document_id, position, author, body; ``new`` has
    merge_key, new_doc, position, author, body. Entries match when trimmed bodies
    and authors are equal, a missing author equalling another. Runs are islands on
    a diagonal of places; of runs as long the first in the new text wins.
    """
    s = stored.select("merge_key", "document_id", F.col("position").alias("p"), "author", trim(F.col("body")).alias("t"))
    n = new.select("merge_key", "new_doc", F.col("position").alias("q"), F.col("author").alias("by"), trim(F.col("body")).alias("u"), F.octet_length("body").alias("bytes"))
    match = n.join(s, (n["merge_key"] == s["merge_key"]) & (n["u"] == s["t"]) & n["by"].eqNullSafe(s["author"])).select("new_doc", "document_id", "q", "p", "bytes")
    diagonal = Window.partitionBy("new_doc", "document_id", F.col("q") - F.col("p")).orderBy("q")
    islands = match.withColumn("island", F.col("q") - F.row_number().over(diagonal)).groupBy("new_doc", "document_id", (F.col("q") - F.col("p")).alias("d"), "island")
    runs = islands.agg(F.min("q").alias("new_start"), F.min("p").alias("old_start"), F.count("*").alias("run_length"), F.sum("bytes").alias("run_bytes"))
    order = F.struct("run_bytes", (-F.col("new_start")).alias("x"), (-F.col("old_start")).alias("y"))
    best = runs.groupBy("new_doc", "document_id").agg(F.max_by(F.struct("new_start", "run_length", "run_bytes"), order).alias("r"))
    return best.select("new_doc", "document_id", "r.*").filter(F.col("run_bytes") >= least)


def positional_merge(stored: DataFrame, new: DataFrame, least: int = MERGE_BYTES) -> DataFrame:
    """Entries of ``new`` to append: new_doc, document_id, position, author, body, and new_position, their place in the new text.

    Each new text goes to the first stored document of its key that overlaps it;
    what comes after the run is appended from the largest position + 1 on, what
    comes before it is dropped. A text with nothing left gives no rows. Texts
    without an overlap are in no row and become documents of their own.
    """
    hits = overlaps(stored, new, least)
    first = hits.groupBy("new_doc").agg(F.min_by(F.struct("document_id", (F.col("new_start") + F.col("run_length")).alias("from")), "document_id").alias("h")).select("new_doc", "h.*")
    top = stored.groupBy("document_id").agg(F.coalesce(F.max("position"), F.lit(0)).alias("top"))
    rest = new.join(first, "new_doc").filter(F.col("position") >= F.col("from")).join(top, "document_id")
    return rest.select("new_doc", "document_id", (F.col("top") + 1 + F.col("position") - F.col("from")).cast("int").alias("position"), "author", "body", F.col("position").alias("new_position"))


def author_runs(entries: DataFrame, doc: str = "document_id") -> DataFrame:
    """Neighbouring entries of one author as one row: run, author, first position, entries, body."""
    order = Window.partitionBy(doc).orderBy("position")
    starts = F.when(F.lag("author").over(order).eqNullSafe(F.col("author")) & (F.lag("position").over(order).isNotNull()), 0).otherwise(1)
    marked = entries.withColumn("run", starts)
    summed = marked.withColumn("run", F.sum("run").over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n")
    return summed.groupBy(doc, "run").agg(F.first("author").alias("author"), F.min("position").alias("first_position"), F.count("*").alias("n_entries"), body.alias("body"))
