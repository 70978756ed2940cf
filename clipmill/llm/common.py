"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Columns that name a text and put it in order, whatever its own columns are called.
KEY = ("none", "id", "mark")
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; a cluster without
    the setting is an error, as a machine-local folder would lose files.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    Survives lost executors, unlike a local checkpoint or a cache.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, not at each mention."""
    return F.transform(F.array(value), body)[0]


def key_of(id_col: str, text_col: str) -> list[Column]:
    """Order of texts: null ids last, then id, then a hash of the text."""
    return [F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` from 1 on in an order, by a range sort and counts of partitions; no task sees all rows."""
    ordered = cut(df.orderBy(*order)).withColumn("part", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ordered.join(F.broadcast(offsets), "part").withColumn(name, F.col("offset") + F.col("mid") + 1).drop("part", "mid", "offset")


def give_back() -> None:
    """Return a Python worker's freed memory to the system.

    Workers are reused from task to task and stage to stage; what the C library
    and Arrow keep of freed blocks would count against the executor all along.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

_FOLDERS: set[str] = set()


def stored_at(df: DataFrame) -> tuple[str, DataFrame]:
    """Write ``df`` as Parquet below the shared folder; its path, to ``remove``, and the table read back."""
    spark = df.sparkSession
    path = work_dir(spark, "stored")
    if not _FOLDERS:
        atexit.register(_remove_all, spark)
    _FOLDERS.add(path)
    written(df, path)
    return path, spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    For loops: unlike a checkpoint the result has sizes of its own, so estimates
    don't multiply from round to round. Its shuffle files go when it is written, the
    folders when the driver ends.
    """
    return stored_at(df)[1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``stored_at`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _FOLDERS.discard(path)


def _remove_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    for path in list(_FOLDERS):
        remove(spark, path)
