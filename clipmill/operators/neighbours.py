"""The next and the previous row of a group, however large the group is."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def neighbours(rows: DataFrame, key: list[str], order: list[str], id_col: str = "id") -> DataFrame:
    """``rows`` with ``next_id`` and ``previous_id`` in their group by ``order`` and id; null at its ends.

    Rows are cut into ranges of (key, order, id), so a large group lies in several
    ranges. Inside a range a window is enough; a group that goes on in another range
    takes its edge from there. Such groups cross a boundary, so there are at most
    two for each range, and their edges are broadcast. Null keys are one group.
    """
    placed = durable(rows.orderBy(*key, *order, id_col)).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", *key).orderBy(*order, id_col)
    near = placed.withColumn("next_id", F.lead(id_col).over(inside)).withColumn("previous_id", F.lag(id_col).over(inside))
    place = F.struct(*[c for c in order if c != id_col], id_col)
    edges = placed.groupBy("part", *key).agg(F.min(place)[id_col].alias("first"), F.max(place)[id_col].alias("last"))
    over = Window.partitionBy(*key).orderBy("part")
    carried = edges.withColumn("after", F.lead("first").over(over)).withColumn("before", F.lag("last").over(over)).filter("after IS NOT NULL OR before IS NOT NULL").drop("first", "last")
    return near.alias("n").join(F.broadcast(carried.alias("c")), same(["part", *key]), "left").select(*[F.col(f"n.{c}") for c in rows.columns], F.coalesce("n.next_id", "c.after").alias("next_id"), F.coalesce("n.previous_id", "c.before").alias("previous_id"))


def same(columns: list[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in columns])
