"""Product codes of vectors, trained by an exponion search in whole numbers.

Each component becomes floor(4096 x); a vector is cut into equal parts, and each
part position has a codebook that starts as that part of the vectors with the
smallest ids. A round assigns every part to its nearest entry and then moves each
entry to the floored mean of its parts.

Exponion search: a part starts at its previous entry a, at squared distance d. By
the triangle inequality an entry farther than 2 sqrt(d) from a can't be as near, so
only those entries are looked at that the list of a's neighbours, sorted by
distance, holds up to the squared distance 4 d. The bound is closed, so equal
distances are found too; they go to the lower index. All distances are exact.

A round reads the table once and writes it once: rows with their new codes, and one
row a task with the sums and counts of each entry, which Spark adds up. The driver
sees codebooks only. The table of the round before goes as soon as the new one
stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, remove, stored_at

SCALE = 4096
#: Components stay below 2^26 (|x| under 16,384), so that squared distances fit a long.
LIMIT = 1 << 26
SMALL_TABLE = 100_000


class Codebooks:
    """Entries as integers (part, entry, component), with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        gaps = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3)
        own = np.arange(entries.shape[1])
        gaps[:, own, own] = -1  # first in its own list, then left out
        self.order = np.argsort(gaps, axis=2, kind="stable")[:, :, 1:]
        self.near = np.take_along_axis(gaps, self.order, axis=2)

    def search(self, p: int, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row of ``x`` in codebook ``p``, and its squared distance."""
        entries = self.entries[p]
        codes, far = start.copy(), ((x - entries[start]) ** 2).sum(1)
        for a in np.unique(start).tolist():
            rows = np.flatnonzero(start == a)
            reach = np.searchsorted(self.near[p, a], 4 * far[rows], side="right")
            by = np.argsort(-reach, kind="stable")
            rows, reach = rows[by], -reach[by]
            own, best, code = x[rows], far[rows], codes[rows]
            for t, e in enumerate(self.order[p, a].tolist()):
                live = int(np.searchsorted(reach, -t, side="left"))  # rows whose ball holds more than t neighbours
                if not live:
                    break
                gap = ((own[:live] - entries[e]) ** 2).sum(1)
                better = (gap < best[:live]) | ((gap == best[:live]) & (e < code[:live]))
                best[:live][better] = gap[better]
                code[:live][better] = e
            codes[rows], far[rows] = code, best
        return codes, far

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, in decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole_numbers(df: DataFrame, vector_col: str, keep: list[str], parts: int) -> DataFrame:
    """(row, ints, codes): kept vectors as integers; every part starts at entry 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    kept = df.filter(v.isNotNull() & F.forall(v, finite) & (F.size(v) > 0) & (F.size(v) % parts == 0))
    scaled = lambda x: F.floor(F.when(F.abs(x) * SCALE < LIMIT, x.cast("double") * SCALE).otherwise(F.raise_error(F.lit(f"a component's size is {LIMIT // SCALE} or more")).cast("double"))).cast("int")
    return kept.select(F.struct(*keep).alias("row"), F.transform(v, scaled).alias("ints"), F.array_repeat(F.lit(0).cast("short"), parts).alias("codes"))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of lists of one length as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind))


def assigned(books: Codebooks, ints: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codes (row, part) and the squared distance over all parts."""
    parts = books.entries.shape[0]
    cells, found, error = ints.reshape(len(ints), parts, -1), np.empty_like(codes), np.zeros(len(ints), np.int64)
    for p in range(parts):
        found[:, p], far = books.search(p, cells[:, p], codes[:, p])
        error += far
    return found, error


def totals(cells: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Per part and entry the count and the sum of each component, flat; exact, as sums of a batch stay below 2^53."""
    out = np.zeros((cells.shape[1], k, 1 + cells.shape[2]), np.int64)
    for p in range(cells.shape[1]):
        out[p, :, 0] = np.bincount(codes[:, p], minlength=k)
        for i in range(cells.shape[2]):
            out[p, :, 1 + i] = np.bincount(codes[:, p], weights=cells[:, p, i], minlength=k)
    return out.reshape(-1)


def one_round(rows: DataFrame, books: Codebooks) -> tuple[str, DataFrame]:
    """A written table of rows with their new codes, and of rows with ``sums`` alone."""
    parts, k, width = books.entries.shape
    kind = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, last = np.zeros(parts * k * (1 + width), np.int64), None
        for batch in batches:
            if batch.num_rows:
                ints = matrix(batch.column("ints"), np.int64)
                codes, _ = assigned(books, ints, matrix(batch.column("codes"), np.int64))
                sums += totals(ints.reshape(len(ints), parts, width), codes, k)
                last = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ints"), lists(codes, pa.int16()), pa.nulls(len(ints), pa.list_(pa.int64()))], ["row", "ints", "codes", "sums"])
                yield last
            give_back()
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(last.schema)[:3]] + [pa.array([sums], pa.list_(pa.int64()))], schema=last.schema)

    return stored_at(rows.mapInArrow(run, f"row {kind.simpleString()}, ints array<int>, codes array<short>, sums array<long>"))


def moved(books: Codebooks, table: DataFrame) -> Codebooks:
    """Entries at the floored means of their parts; entries without parts stay."""
    parts, k, width = books.entries.shape
    added = table.filter("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # parts x entries x (1 + components) rows
    flat = np.zeros(parts * k * (1 + width), np.int64)
    for pos, n in added:
        flat[pos] = n
    flat = flat.reshape(parts, k, 1 + width)
    count = flat[:, :, :1]
    return Codebooks(np.where(count > 0, flat[:, :, 1:] // np.maximum(count, 1), books.entries))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks): struct ``row`` of the columns ``keep``, ``codes`` (an index a part) and ``error`` (long).

    Rows whose vector is null, holds null or non-finite components, or can't be cut
    into ``parts`` parts are dropped, as are vectors of another length than that of
    the smallest id. Null ids come last, equal ids are ordered by their vectors;
    rows that repeat count each. With fewer than ``entries`` vectors the codebooks
    are that short; an empty table has no rows and empty codebooks. Entries that are
    alike: the lower index takes all. A component of 16,384 or more is an error.
    """
    rows = whole_numbers(df, vector_col, sorted({id_col, *(keep or [id_col])}), parts)
    own, spark = F.col(f"row.{id_col}"), df.sparkSession
    first = rows.select(own.alias("id"), "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(1).collect()
    if not first:
        return rows.select("row", "codes", F.lit(0).cast("long").alias("error")).limit(0), Codebooks(np.zeros((parts, 0, 0), np.int64))
    width = len(first[0].ints)
    rows = rows.filter(F.size("ints") == width)
    start = rows.select(own.alias("id"), "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    books = Codebooks(np.ascontiguousarray(np.array([r.ints for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)))
    path = None
    for _ in range(rounds):
        before, (path, table) = path, one_round(rows, books)
        books = moved(books, table)
        rows = table.filter("ints IS NOT NULL").drop("sums")
        if before:
            remove(spark, before)
    final = cut(encoded(rows, books))
    if path:
        remove(spark, path)
    return final, books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(row, codes, error) by a last search over (row, ints, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = assigned(books, matrix(batch.column("ints"), np.int64), matrix(batch.column("codes"), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("row"), lists(codes, pa.int16()), pa.array(error)], ["row", "codes", "error"])
            give_back()

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, codes array<short>, error long")


def digest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256; cases as in ``compress``, null labels together."""
    rows, books = compress(df, id_col, vector_col, [id_col, label_col])
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    flat = rows.select(F.col(f"row.{id_col}").alias("vec_id"), F.col(f"row.{label_col}").alias("label"), code.alias("code"), "error")
    sums = cut(flat.groupBy("label").agg(F.sum("error").alias("label_error")))  # map-side sums: a hot label is no hot group
    if sums.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        sums = F.broadcast(sums)
    joined = flat.alias("r").join(sums.alias("s"), F.col("r.label").eqNullSafe(F.col("s.label")))
    return joined.select("r.vec_id", "r.code", "r.error", "s.label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """SQL of ``digest``: a pair of common table expressions a round."""
    text = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS uid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cells AS (SELECT uid, p, list_slice(ints, p * len(ints) // {parts} + 1, (p + 1) * len(ints) // {parts}) AS v FROM kept, range({parts}) r(p)),
book0 AS (SELECT p, uid - 1 AS e, v AS c FROM cells WHERE uid <= {entries})"""
    for r in range(rounds + 1):
        text += f""",
near{r} AS MATERIALIZED (
  SELECT uid, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT uid, p, v, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cells JOIN book{r} USING (p))
  GROUP BY uid, p, v)"""
        if r < rounds:
            text += f""",
sums{r} AS (
  SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY p, e, i),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{r} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
    return (
        text
        + f""",
coded AS (SELECT uid, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY uid),
named AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM book{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (uid), named
"""
    )


ORACLE = oracle()
