"""A stored index for cosine search: inverted lists of quantised residuals, then exact vectors.

Layout below a folder:

- ``centroids``: (list, centroid, n) of the lists, and the number of probes that the
  recall asked for took on sampled queries.
- ``codes``: (list, id, code, scale, error), in the order of lists and in few files. A
  code is the residual of a vector's direction from its centroid, one byte a
  component; ``error`` is the length of what the byte leaves out.
- ``vectors``: (id, embedding), a folder ``list=N`` each.

A search scores the codes of the probed lists. As a true similarity differs from
that of a code by ``error`` at most, the k best lower bounds say which codes can
still be among the k nearest; only their vectors are read, from the folders of
their lists. Inside the probed lists the result is exact, and with all lists
probed it is that of the exact search.

Vectors without a direction or of another length than the centroids form list -1,
which is compared as it is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable
from .vector import cosine

MOST_LISTS = 4096  # centroids are broadcast
SAMPLE = 1 << 18  # vectors that centroids are fitted on, at most about
QUERIES = 64  # sampled for the choice of probes
MOST_QUERIES = 4096  # in one pass over the codes
CELLS = 1 << 20  # of a table of similarities in a task: 8 MB each
ODD = -1
CODES = "list int, id long, code binary, scale float, error float"


def unit(rows: np.ndarray) -> np.ndarray:
    """Directions; rows without one become 0."""
    rows = np.nan_to_num(rows.astype(np.float64))
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fraction_of(key: Column, seed: int) -> Column:
    """A number in [0, 1) that a row's key fixes."""
    return F.xxhash64(F.lit(seed), key).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def regular(width: int) -> Column:
    """Whether a vector has the usual length, finite components and a direction."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") == width) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def fitted(vectors: DataFrame, lists: int, seed: int) -> np.ndarray:
    """Centroids (unit length) of a bounded sample, by Spark's k-means on directions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import Normalizer

    points = Normalizer(inputCol="v", outputCol="features").transform(vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    model = KMeans(k=lists, seed=seed, maxIter=12, initMode="random").fit(points.select("features"))
    return unit(np.array(model.clusterCenters()))


def parts(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose products with so many columns have ``CELLS`` cells at most, or a row each."""
    step = max(1, CELLS // max(1, columns))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encoder(centroids: np.ndarray):
    """A function over Arrow batches of (id, embedding) that gives ``CODES`` and the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, len(centroids)):
            x = unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            nearest = (x @ centroids.T).argmax(1).astype(np.int32)
            rest = x - centroids[nearest]
            scale = np.maximum(np.abs(rest).max(1), 1e-30) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            scale32 = scale.astype(np.float32)
            error = np.linalg.norm(rest - code * scale32.astype(np.float64)[:, None], axis=1) * 1.000001 + 1e-9  # rounded up
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(nearest), batch.column("id"), codes, pa.array(scale32), pa.array(np.nextafter(error.astype(np.float32), np.float32(np.inf))), batch.column("embedding")], ["list", "id", "code", "scale", "error", "embedding"])

    return run


class VectorIndex:
    """An index in a folder; ``build`` makes one, ``search`` opens only what a query needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        rows = spark.read.parquet(f"{self.folder}/centroids").collect()  # MOST_LISTS rows at most, and one
        self.probes = max((r.probes for r in rows), default=0)
        self.sizes = {r.list: r.n for r in rows}
        self.ids = sorted(i for i in self.sizes if i != ODD)
        by_id = {r.list: r.centroid for r in rows}
        self.centroids = np.array([by_id[i] for i in self.ids], np.float64) if self.ids else np.zeros((0, 0))

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, lists: int | None = None, target: float = 0.97, k: int = 10, seed: int = 5) -> VectorIndex:
        """Index all rows (id, embedding) of a table into a new folder.

        ``lists``: four times the root of the number of vectors unless given. Centroids
        are fitted on about ``SAMPLE`` vectors and all vectors are indexed. The number
        of probes is the least that holds ``target`` of the ``k`` nearest of ``QUERIES``
        sampled vectors, found by brute force over all vectors.
        """
        spark = vectors.sparkSession
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        common = rows.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
        width = common.width if common else 1
        good = rows.filter(regular(width))
        n = good.count()
        lists = max(1, min(MOST_LISTS, n, lists or int(4 * n**0.5)))
        centroids = np.zeros((0, width))
        if n:
            centroids = fitted(good.filter(fraction_of(F.col("id"), seed) < SAMPLE / n), lists, seed)
        encoded = durable(good.mapInArrow(encoder(centroids), CODES + ", embedding array<float>")) if n else spark.createDataFrame([], CODES + ", embedding array<float>")
        odd = rows.filter(~regular(width)).select(F.lit(ODD).alias("list"), "id", "embedding")
        whole = encoded.select("list", "id", "embedding").unionByName(odd)
        whole.repartition("list", F.floor(fraction_of(F.col("id"), 1) * F.lit(cls.pieces(n, lists)))).sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{folder}/vectors")
        encoded.drop("embedding").repartitionByRange(cls.code_files(n, width), "list", "id").sortWithinPartitions("list", "id").write.parquet(f"{folder}/codes")
        probes = probes_for(good, encoded.select("id", "list"), centroids, target, k, seed) if n else 0
        counts = dict(whole.groupBy("list").count().collect())
        known = [(i, [float(x) for x in c], counts.get(i, 0), probes) for i, c in enumerate(centroids)] + [(ODD, None, counts.get(ODD, 0), probes)]
        spark.createDataFrame(known, "list int, centroid array<double>, n long, probes int").coalesce(1).write.parquet(f"{folder}/centroids")
        return cls(spark, folder)

    @staticmethod
    def pieces(n: int, lists: int) -> int:
        """Files of a list: one for a million vectors."""
        return max(1, n // lists >> 20)

    @staticmethod
    def code_files(n: int, width: int) -> int:
        return max(1, n * width >> 27)

    def add(self, vectors: DataFrame) -> None:
        """Append new ids under the present centroids; many additions ask for a new build."""
        rows = durable(vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")))
        usual = regular(self.centroids.shape[1]) if self.ids else F.lit(False)
        encoded = durable(rows.filter(usual).mapInArrow(encoder(self.centroids), CODES + ", embedding array<float>"))
        whole = encoded.select("list", "id", "embedding").unionByName(rows.filter(~usual).select(F.lit(ODD).alias("list"), "id", "embedding"))
        whole.repartition("list").sortWithinPartitions("id").write.mode("append").partitionBy("list").parquet(f"{self.folder}/vectors")
        encoded.drop("embedding").repartitionByRange(1, "list", "id").sortWithinPartitions("list", "id").write.mode("append").parquet(f"{self.folder}/codes")
        more = dict(whole.groupBy("list").count().collect())
        for i, n in more.items():
            self.sizes[i] = self.sizes.get(i, 0) + n

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Which lists (columns) each query (row) looks into."""
        order = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        chosen = np.zeros((len(queries), len(self.ids)), bool)
        np.put_along_axis(chosen, order, True, axis=1)
        return chosen

    def search(self, query: list[float], k: int, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """The k nearest (id, similarity), ties to the smaller id; ``allowed`` (id): only among those."""
        return self.search_many([(0, query)], k, probes, allowed).drop("query")

    def search_many(self, queries: list[tuple[int, list[float]]], k: int, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query, id, similarity): the k nearest of each query, ``MOST_QUERIES`` at a time."""
        if len(queries) > MOST_QUERIES:
            parts = [self.search_many(queries[i : i + MOST_QUERIES], k, probes, allowed) for i in range(0, len(queries), MOST_QUERIES)]
            return functools.reduce(DataFrame.unionByName, parts)
        finalists = self.finalists([q for _, q in queries], k, probes or self.probes, allowed)
        lists = [r.list for r in finalists.select("list").distinct().collect()]  # MOST_LISTS at most
        asked = F.broadcast(self.spark.createDataFrame([(at, int(name), [float(x) for x in q]) for at, (name, q) in enumerate(queries)], "at int, query long, q array<double>"))
        near = self.vectors(lists).join(F.broadcast(finalists.drop("list")) if self.few(finalists) else finalists.drop("list"), "id")
        if self.sizes.get(ODD):
            odd = self.vectors([ODD])
            near = near.unionByName((odd.join(allowed.select("id"), "id", "left_semi") if allowed is not None else odd).crossJoin(asked.select("at")))
        scored = near.join(asked, "at").select("query", "id", cosine(F.col("embedding"), F.col("q")).alias("similarity"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        return scored.withColumn("place", place).filter(F.col("place") <= k).drop("place")

    @staticmethod
    def few(rows: DataFrame, most: int = 100_000) -> bool:
        return rows.limit(most + 1).count() <= most

    def vectors(self, lists: list[int]) -> DataFrame:
        """(id, embedding) of some lists; no other folder is opened."""
        return self.spark.read.schema("id long, embedding array<float>, list int").parquet(f"{self.folder}/vectors").filter(F.col("list").isin(*lists) if lists else F.lit(False)).select("id", "embedding")

    def finalists(self, queries: list[list[float]], k: int, probes: int, allowed: DataFrame | None) -> DataFrame:
        """(at, id, list) of all codes in probed lists that may be among the k nearest of query ``at``."""
        empty = self.spark.createDataFrame([], "at int, id long, list int")
        if not self.ids or not queries:
            return empty
        width = self.centroids.shape[1]
        q = unit(np.array([(list(v) + [0.0] * width)[:width] for v in queries], np.float64))
        chosen, base = self.probed(q, probes), q @ self.centroids.T
        lists = [self.ids[i] for i in np.flatnonzero(chosen.any(0))]
        codes = self.spark.read.schema(CODES).parquet(f"{self.folder}/codes").filter(F.col("list").isin(*lists))
        codes = codes.join(allowed.select("id"), "id", "left_semi") if allowed is not None else codes
        known = self.spark.sparkContext.broadcast((q, chosen, base))

        def bounds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Similarity of each code (row) and query (column), the error, and which codes a query may not see."""
            asked, seen, start = known.value
            own = batch.column("list").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
            near = start[:, own].T + (code.astype(np.float32) @ asked.T.astype(np.float32)).astype(np.float64) * batch.column("scale").to_numpy().astype(np.float64)[:, None]
            return near, batch.column("error").to_numpy().astype(np.float64)[:, None] + 1e-5, ~seen[:, own].T

        def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((k, len(queries)), -np.inf)
            for batch in parts(batches, len(queries)):
                if batch.num_rows:
                    near, error, hidden = bounds(batch)
                    low = np.where(hidden, -np.inf, near - error)
                    best = -np.partition(-np.concatenate([best, low]), k - 1, axis=0)[:k]
            at = np.tile(np.arange(len(queries), dtype=np.int32), k)
            kept = np.isfinite(best.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(at[kept]), pa.array(best.reshape(-1)[kept])], ["at", "low"])

        place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("low")))
        lows = codes.mapInArrow(lowest, "at int, low double").withColumn("place", place).filter(F.col("place") == k)  # k rows of a query from each task
        floor = np.full(len(queries), -np.inf)
        for r in lows.collect():
            floor[r.at] = r.low

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, len(queries)):
                if batch.num_rows:
                    near, error, hidden = bounds(batch)
                    row, at = np.nonzero(~hidden & (near + error >= floor[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("id").take(pa.array(row)), batch.column("list").take(pa.array(row))], ["at", "id", "list"])

        return durable(codes.mapInArrow(possible, "at int, id long, list int"))


def probes_for(good: DataFrame, lists: DataFrame, centroids: np.ndarray, target: float, k: int, seed: int) -> int:
    """The least number of probes that holds ``target`` of the k nearest of sampled vectors."""
    n = lists.count()
    sample = good.filter(fraction_of(F.col("id"), seed + 1) < 4 * QUERIES / n).limit(QUERIES).collect()
    if not sample:
        return len(centroids)
    q = unit(np.array([r.embedding for r in sample], np.float64))
    own = np.array([r.id for r in sample])
    known = good.sparkSession.sparkContext.broadcast((q, own))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, near = np.zeros((k, len(own)), np.int64), np.full((k, len(own)), -np.inf)
        for batch in batches:
            if len(batch):
                asked, names = known.value
                key = batch["id"].to_numpy()
                found = unit(np.stack(batch["embedding"].to_numpy())) @ asked.T
                found[key[:, None] == names[None, :]] = -np.inf
                both, keys = np.concatenate([near, found]), np.concatenate([ids, np.repeat(key[:, None], len(names), 1)])
                best = np.argpartition(-both, k - 1, axis=0)[:k]
                ids, near = np.take_along_axis(keys, best, 0), np.take_along_axis(both, best, 0)
        at = np.tile(np.arange(len(own)), k)
        kept = np.isfinite(near.reshape(-1))
        yield pd.DataFrame({"at": at[kept], "id": ids.reshape(-1)[kept], "similarity": near.reshape(-1)[kept]})

    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("similarity"), "id"))
    top = good.mapInPandas(nearest, "at long, id long, similarity double").withColumn("place", place).filter(F.col("place") <= k)
    rank = np.empty((len(own), len(centroids)), np.int64)
    np.put_along_axis(rank, np.argsort(-(q @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None, :].repeat(len(own), 0), 1)
    needed = np.sort([rank[r.at, r.list] + 1 for r in top.join(lists, "id").select("at", "list").collect()])  # k rows a query
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else len(centroids)
