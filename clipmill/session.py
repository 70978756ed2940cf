"""Spark sessions with the settings this library is written for."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, partitions: int | None = None, name: str = "clipmill") -> SparkSession:
    """Get or make a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def spread(df: DataFrame, least: int = 2 << 20) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than that, as one file of one row group does.

    Large inputs have more tasks than cores and stay as they are; so do those under
    ``least`` bytes. Rows and columns are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < least or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may do without the setting."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that the cluster shares and read on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_FOLDERS: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a query's shuffle files go with its end


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_remove_all, spark)
    _FOLDERS.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    For loops: unlike a checkpoint the result has sizes of its own, so estimates
    don't multiply from round to round. Its shuffle files go when it is written, the
    folders when the driver ends.
    """
    path = scratch(df.sparkSession, "stored")
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; its shuffle files go with the end of the write."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)


def freed(spark: SparkSession, *done: DataFrame) -> None:
    """Give disk back: the folders of ``done`` (from ``stored``), and shuffle files that no plan needs any more.

    Spark drops shuffle files once the driver's memory is collected, which with a
    large heap may come after the job; so it is asked for here. Nothing may read
    ``done`` afterwards.
    """
    for df in done:
        names = {name.rsplit("/", 2)[-2] for name in df.inputFiles()}
        for path in [p for p in _FOLDERS if p.rsplit("/", 1)[-1] in names]:
            _FOLDERS.remove(path)
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark._jvm.System.gc()


def _remove_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    for path in _FOLDERS:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
