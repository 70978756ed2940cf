"""Importance resampling of documents towards a target collection.

Features are runs of consecutive words, hashed into ``BUCKETS`` buckets. Two passes
over the texts in Arrow batches:

1. Each partition makes one vector of bucket counts with ``np.bincount``; the
   vectors are merged by ``treeReduce``, so the driver sees about the square root
   of the partitions' number of them, 80 kB each. Source and target texts alike.
2. The gains, one number a bucket, are broadcast (80 kB, whatever the corpus). A
   batch gathers them by the buckets of its words and sums them per document with
   ``np.bincount(..., weights=...)``. Sums are exact below 2^53.

A score adds seeded Gumbel noise to the weight, so that the highest scores are a
draw without replacement. Scores are put in order by a range sort of narrow rows
and counts of partitions; no task sees all of them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, numbered, stored

BUCKETS = 10_000
SEED = 2024
ROWS = 256  # texts turned into Python strings at a time
SCORED = "n_words long, n_features long, weight long, score long"

#: Bytes of words stay, A-Z in lower case; all other ASCII bytes part words.
PARTS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def buckets_of(text: str | None, grams: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of 1 to ``grams`` of them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(PARTS).split()
    runs = words + [b" ".join(words[i : i + n]) for n in range(2, grams + 1) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % BUCKETS


def bucket_counts(df: DataFrame, text_col: str = "text", grams: int = 1) -> np.ndarray:
    """How many features of all texts fall in each bucket (first pass)."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                found = [buckets_of(t, grams)[1] for t in batch.column(0).slice(start, ROWS).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=BUCKETS)
            give_back()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["vector"])

    vectors = df.select(F.col(text_col).alias("text")).mapInArrow(partition, "vector binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    nothing = df.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)  # an empty table has no vectors
    return vectors.union(nothing).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the smoothed ratio of its share in the target to that in the source)."""
    all_source, all_target = int(source.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(all_source + BUCKETS)) / (float(s + 1) * float(all_target + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str | None, seed: int) -> int:
    """Seeded Gumbel noise of a row in thousandths; a null id is the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", grams: int = 1, seed: int = SEED) -> DataFrame:
    """All rows of ``df`` as struct ``row`` with n_words, n_features, weight and score (second pass).

    Null and texts without words have no features and weight 0. Rows that repeat
    id and text score alike. Counts are of all rows of both tables; an empty table
    counts nothing, and an empty ``df`` gives no rows. Texts are read whole.
    """
    found = gains(bucket_counts(df, text_col, grams), bucket_counts(target, target_col, grams)).astype(np.float64)
    table = df.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf(T._parse_datatype_string(SCORED))
    def score(keys: pa.Array, texts: pa.Array) -> pa.Array:
        words, sizes, weights = [], [], [np.zeros(0, np.int64)]
        for start in range(0, len(texts), ROWS):
            some = [buckets_of(t, grams) for t in texts.slice(start, ROWS).to_pylist()]
            own = np.array([len(b) for _, b in some], np.int64)
            owner = np.repeat(np.arange(len(some)), own)
            weights.append(np.bincount(owner, weights=table.value[np.concatenate([b for _, b in some])], minlength=len(some)).astype(np.int64))
            words += [n for n, _ in some]
            sizes += own.tolist()
        weight = np.concatenate(weights)
        drawn = weight + np.array([noise(k, seed) for k in keys.to_pylist()], np.int64)
        give_back()
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(weight), pa.array(drawn)], ["n_words", "n_features", "weight", "score"])

    return df.select(F.struct("*").alias("row"), score(F.col(id_col).cast("string"), F.col(text_col)).alias("s")).select("row", "s.*")


def ranked(scored: DataFrame, min_words: int = 20, percent: int = 10) -> DataFrame:
    """``scored`` (a written table with doc_id, uid, n_words, score) with ``rank``, null for rows not drawn.

    Of the rows with ``min_words`` words, that percentage is drawn by falling
    score; ties go to the smaller id, null ids last, and of rows that repeat each
    takes a place of its own. No rows, or too few for one, draw none.
    """
    fit = scored.filter(F.col("n_words") >= min_words)
    take = fit.count() * percent // 100
    order = ["down", "none", "doc_id", "uid"]
    keyed = fit.withColumn("down", -F.col("score")).withColumn("none", F.col("doc_id").isNull())
    places = numbered(keyed, order, "place").drop("down", "none")
    drawn = places.withColumn("rank", F.when(F.col("place") <= take, F.col("place"))).drop("place")
    return drawn.unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def digest(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; texts don't leave the second pass."""
    scored = weigh(df.select(id_col, text_col), target, id_col, text_col)
    narrow = cut(scored.select(F.col(f"row.{id_col}").alias("doc_id"), "n_words", "n_features", "weight", "score").withColumn("uid", F.monotonically_increasing_id()))
    return ranked(narrow).select("doc_id", "n_features", "weight", "score", "rank")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, percent: int = 10, grams: int = 1, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``df``, whole and with its columns; cases as in ``weigh`` and ``ranked``.

    Only narrow rows are sorted: the last drawn row's place is a bound that each
    written row is compared with, so texts aren't shuffled.
    """
    rows = stored(weigh(df, target, id_col, text_col, grams=grams, seed=seed).withColumn("uid", F.monotonically_increasing_id()))
    rows = rows.withColumn("doc_id", F.col(f"row.{id_col}"))
    last = ranked(rows.select("doc_id", "uid", "n_words", "score"), min_words, percent).filter("rank IS NOT NULL").agg(F.max(F.struct("rank", "score", "doc_id", "uid")).alias("at")).first().at
    if last is None:
        return rows.select("row.*").limit(0)
    none, own = F.col("doc_id").isNull(), F.col("doc_id")
    smaller = F.lit(False) if last.doc_id is None else own < F.lit(last.doc_id)
    alike = none if last.doc_id is None else own == F.lit(last.doc_id)
    before = (~none if last.doc_id is None else smaller) | (alike & (F.col("uid") <= last.uid))
    inside = (F.col("score") > last.score) | ((F.col("score") == last.score) & F.coalesce(before, F.lit(False)))
    return rows.filter((F.col("n_words") >= min_words) & inside).select("row.*")


#: CRC-32 of each distinct word, a byte a turn, over a table made from the polynomial.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT i, c AS t FROM bits WHERE k = 8),
both_texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
rows AS (
  SELECT row_number() OVER () AS uid, side, id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM both_texts),
tokens AS MATERIALIZED (SELECT uid, side, unnest(words) AS word FROM rows),
steps AS (
  SELECT word, hex(encode(word)) AS h, 0 AS p, 4294967295::BIGINT AS c FROM (SELECT DISTINCT word FROM tokens)
  UNION ALL
  SELECT word, h, p + 1, xor(c >> 8, t) FROM steps JOIN crc_table ON i = xor(c, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT) & 255 WHERE 2 * p < length(h)),
hashed AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM steps WHERE 2 * p = length(h)),
counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM tokens JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counted),
gained AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counted, totals),
weighed AS (SELECT uid, sum(gain)::BIGINT AS weight FROM tokens JOIN hashed USING (word) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY uid),
scored AS (
  SELECT uid, id AS doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM rows LEFT JOIN weighed USING (uid) WHERE side = 'd'),
placed AS (
  SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (uid)
"""
