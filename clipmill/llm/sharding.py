"""Shards of near-equal bytes by sampled splitters.

Rows are ordered by a key: a hash of the text, one of the id, and the row's place in
a written table, so no two keys are equal and any range can be divided. Rows of
equal texts stand together.

1. A sample draws keys with a chance in proportion to their rows' sizes; its
   quantiles are the splitters of ranges of about equal bytes.
2. Rows and bytes of each range are counted over all rows. Ranges with too many rows
   for one task (many short texts, a hot text) are subdivided by splitters sampled
   inside them, until none is left.
3. Rows are partitioned by range and put in order inside; with the counts of the
   ranges before, each row knows its place and the bytes before it.
4. Shard boundaries lie at equal steps of all bytes. A row goes where its middle
   lies; a group of equal texts goes where the group's middle lies, unless it holds
   more than ``WHOLE`` of a shard: an overfull group is divided at the boundary. So
   a shard is off by half a row, or half a small group, at either end.

The driver sees the sampled keys (``DRAWN`` a range) and a count per range, one range
for a million rows, and at most one group a boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, stored

SHARDS = 8
ROWS_A_RANGE = 1 << 20  # rows that one task puts in order; twice as many are overfull
RANGES = 64  # at least
DRAWN = 32  # sampled keys a range
WHOLE = 64  # a group of up to a 64th of a shard isn't divided
LAW = "bytes"
KEY = ("h", "t", "uid")


def hashed(value: Column) -> Column:
    """60 bits, not negative."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def narrow(df: DataFrame, id_value: Column, text_value: Column, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, h and t, then ``more``; a null text has size 1, as an empty one."""
    text = F.coalesce(text_value, F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    order = hashed(text).alias("h"), hashed(F.coalesce(id_value.cast("string"), F.lit(""))).alias("t")
    return df.select(id_value.alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *order, *more)


def joined(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as strings of bytes that sort as their columns do."""
    return np.ascontiguousarray(np.stack(columns, axis=1).astype(">i8")).view("S24").reshape(-1)


def in_range(cuts: np.ndarray) -> Column:
    """The number of the range that a row's key lies in."""

    @F.arrow_udf(T.IntegerType())
    def place(h: pa.Array, t: pa.Array, uid: pa.Array) -> pa.Array:
        keys = joined([c.to_numpy(zero_copy_only=False) for c in (h, t, uid)]) if len(h) else np.zeros(0, "S24")
        return pa.array(np.searchsorted(cuts, keys, side="right").astype(np.int32))

    return place(*[F.col(c) for c in KEY])


def sample(rows: DataFrame, chance: Column, turn: int) -> np.ndarray:
    """Sorted keys of rows drawn by a hash of their key, the same in each rerun."""
    dice = F.xxhash64(F.lit(turn), *KEY).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    drawn = rows.filter(dice < chance).select(*KEY).collect()  # DRAWN rows a range, on the whole
    return np.sort(joined([np.array(c, np.int64) for c in zip(*drawn, strict=True)])) if drawn else np.zeros(0, "S24")


def quantiles(keys: np.ndarray, pieces: int) -> np.ndarray:
    """Keys at equal steps that cut the sample in ``pieces`` pieces."""
    step = max(1, len(keys) // pieces)
    return np.unique(keys[step // 2 :: step])


def counted(rows: DataFrame, cuts: np.ndarray) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each range."""
    found = rows.select("size", in_range(cuts).alias("range")).groupBy("range").agg(F.count("*"), F.sum("size")).collect()  # a row a range
    return {r[0]: (r[1], r[2]) for r in found}


def splitters(rows: DataFrame, n: int, total: int, rows_a_range: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Splitters of ranges that one task can order, and their counts."""
    pieces = max(RANGES, -(-n // rows_a_range))
    cuts = quantiles(sample(rows, F.col("size") * (DRAWN * pieces / total), 0), pieces)
    counts, turn = counted(rows, cuts), 0
    while over := [(r, c, -(-c // rows_a_range)) for r, (c, _) in counts.items() if c > 2 * rows_a_range]:
        turn += 1
        chances = F.broadcast(rows.sparkSession.createDataFrame([(r, DRAWN * p / c) for r, c, p in over], "range int, chance double"))
        inside = rows.withColumn("range", in_range(cuts)).join(chances, "range")
        cuts = np.union1d(cuts, quantiles(sample(inside, F.col("chance"), turn), sum(p for _, _, p in over)))
        counts = counted(rows, cuts)
    return cuts, counts


def assign(rows: DataFrame, shards: int = SHARDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``rows`` (a written table with size and KEY) with ``shard`` and ``slot``."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    spark = rows.sparkSession
    cuts, counts = splitters(rows, n, total, rows_a_range)
    offsets, place, before = [], 0, 0
    for r in sorted(counts):
        offsets.append((r, place, before))
        place, before = place + counts[r][0], before + counts[r][1]
    known = F.broadcast(spark.createDataFrame(offsets, "range int, place long, before long"))  # a row a range
    order = Window.partitionBy("range").orderBy(*KEY)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("range", in_range(cuts)).join(known, "range")
    placed = cut(inside.select(*rows.columns, (F.col("place") + F.row_number().over(order) - 1).alias("place"), (F.col("before") + F.sum("size").over(upto) - F.col("size")).alias("before")))
    step = F.expr(f"(before * {shards} + {total} - 1) div {total}")  # the first boundary at or after the row's start
    at = placed.filter(step.between(1, shards - 1) & (step * total < (F.col("before") + F.col("size")) * shards)).select("h").distinct().collect()  # a row a boundary at most
    groups = placed.filter(F.col("h").isin(*[r.h for r in at])).groupBy("h").agg(F.min("before").alias("start"), F.sum("size").alias("held"))
    small = [(h, start, held) for h, start, held in groups.collect() if held * shards * WHOLE <= total]
    whole = F.broadcast(spark.createDataFrame(small, "h long, start long, held long"))
    middle = F.coalesce(2 * F.col("start") + F.col("held"), 2 * F.col("before") + F.col("size"))
    exact = F.expr(f"int(cast(middle AS decimal(28,0)) * cast({shards} AS decimal(10,0)) div cast({2 * total} AS decimal(38,0)))")
    sharded = placed.join(whole, "h", "left").withColumn("middle", middle).withColumn("shard", exact)
    firsts = F.broadcast(sharded.groupBy("shard").agg(F.min("place").alias("first")))  # a row a shard
    return sharded.join(firsts, "shard").select(*rows.columns, "shard", (F.col("place") - F.col("first")).alias("slot"))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) of every row.

    Null and empty texts are one group of size 1 each. Rows that repeat id and text
    are put in order by their places and can be told apart only by those. Texts of
    any length are one row each and never divided: a text longer than a shard's share
    leaves other shards short. An empty table gives no rows.
    """
    rows = cut(narrow(df, F.col(id_col), F.col(text_col)).withColumn("uid", F.monotonically_increasing_id()))
    return assign(rows, shards, rows_a_range).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """All rows as struct ``row`` with size, ``shard`` and ``slot``; cases as in ``digest``.

    Rows are written once with their place; only narrow rows are put in order, and
    their shards are joined to the written rows.
    """
    written = stored(df.select(F.struct("*").alias("row")).withColumn("uid", F.monotonically_increasing_id()))
    keys = cut(narrow(written, F.col(f"row.{id_col}"), F.col(f"row.{text_col}"), F.col("uid")))
    return written.join(assign(keys, shards, rows_a_range).select("uid", "size", "shard", "slot"), "uid").select("row", "size", "shard", "slot")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rows_a_file: int = 1 << 17) -> DataFrame:
    """Write the rows below ``path``, a folder ``shard=N`` each, in the order of their slots; returns rows and bytes of each shard."""
    placed = stored(sharded(df, id_col, text_col, shards).withColumn("file", F.floor(F.col("slot") / rows_a_file)))
    placed.repartition("shard", "file").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
crcs AS MATERIALIZED (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
                               lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc_table),
base AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS t
  FROM documents),
run AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS place, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY h) AS held
  FROM base WINDOW w AS (ORDER BY h, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
middles AS (
  SELECT *, CASE WHEN held * 8 * 64 <= total THEN 2 * min(upto - size) OVER (PARTITION BY h) + held ELSE 2 * upto - size END AS middle FROM run),
placed AS (SELECT *, (8 * middle // (2 * total))::INTEGER AS shard FROM middles)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed JOIN crcs USING (text)
"""
