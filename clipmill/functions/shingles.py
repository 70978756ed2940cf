"""Three-word shingles, signatures and set similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .md5_lanes import signer

LANES = 128
EMPTY = (1 << 63) - 1
SIGNED = 256  # names in a step: their hashes stay in the cache
# Thresholds of the verdicts.
AUTO, GRAY, TITLE, LEAST_SIZE, CONTAINED, BLOCK_WORDS = 0.7, 0.4, 0.1, 48, 0.8, 300


def shingle_words(text: Column) -> Column:
    """Words reduced to lower-case letters and digits; words without any vanish. One pass over the text, then the split."""
    plain = F.lower(F.regexp_replace(text, r"(?U)[^\p{IsAlphabetic}\p{N}\s]", ""))
    return F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")


def with_shingles(df: DataFrame, text: str = "text", out: str = "shingles") -> DataFrame:
    """``df`` plus its array of shingles with repeats; under three words, the words.

    The generators keep the arrays from being computed anew for each element.
    """
    w = "__words"
    many = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    worded = df.select("*", F.explode(F.array(shingle_words(F.coalesce(F.col(text), F.lit(""))))).alias(w))
    return worded.select("*", F.explode(F.array(F.when(F.size(w) < 3, F.col(w)).otherwise(many))).alias(out)).drop(w)


def with_sequence(df: DataFrame, text: str = "text", out: str = "seq") -> DataFrame:
    """``df`` plus its shingles in order as 64-bit names, without making their strings."""
    w = "__words"
    word = lambda i: F.get(F.col(w), i)
    many = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    worded = df.select("*", F.explode(F.array(shingle_words(F.coalesce(F.col(text), F.lit(""))))).alias(w))
    short = F.transform(w, lambda x: F.xxhash64(x))
    return worded.select("*", F.when(F.size(w) < 3, short).otherwise(many).alias(out)).drop(w)


def with_names(df: DataFrame, text: str = "text", out: str = "names") -> DataFrame:
    """``df`` plus its distinct shingles as sorted 64-bit names."""
    seq = "__seq"
    return with_sequence(df, text, seq).select("*", F.array_sort(F.array_distinct(seq)).alias(out)).drop(seq)


def shingle_set(shingles: Column) -> Column:
    """Distinct shingles as 64-bit names."""
    return F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s)))


def _lane_constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 62, LANES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, LANES, np.uint64)


MULTIPLY, ADD = _lane_constants()


def signature_of(names: np.ndarray) -> np.ndarray:
    """128 minima of affine hashes; an empty set has the largest value in every lane."""
    if not len(names):
        return np.full(LANES, EMPTY, np.int64)
    low = np.full(LANES, EMPTY, np.int64)
    for at in range(0, len(names), SIGNED):
        h = names[at : at + SIGNED].view(np.uint64)[:, None] * MULTIPLY
        h += ADD
        h ^= h >> np.uint64(31)
        h >>= np.uint64(1)
        low = np.minimum(low, h.min(0).view(np.int64))
    return low


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(names: pd.Series) -> pd.Series:
    """Signature of an array of 64-bit names."""
    return pd.Series([signature_of(np.asarray(n, np.int64)) for n in names])


def minhash_md5(df: DataFrame, key: str, shingles: str, lanes: int) -> DataFrame:
    """(key, lows): the same idea with portable md5 strings, an array of all lanes; nothing is shuffled. Empty sets have none."""
    kind = df.schema[key].dataType.simpleString()
    sets = df.filter(F.size(shingles) > 0).select(F.col(key).alias("key"), F.array_distinct(shingles).alias("names"))
    return sets.mapInArrow(signer(lanes), f"key {kind}, lows array<string>").withColumnRenamed("key", key)


def signature_jaccard(a: Column, b: Column) -> Column:
    """Share of equal lanes."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def equal_lanes(a: np.ndarray, b: np.ndarray) -> float:
    """The same of two arrays."""
    return int(np.count_nonzero(a == b)) / len(a)


def estimated_overlap(j: Column, a: Column, b: Column) -> Column:
    """Estimated share of the smaller set that lies in the other."""
    least = F.least(a, b)
    return F.when((least == 0) | (j <= 0), 0.0).otherwise(F.least(F.lit(1.0), j * (a + b) / (1 + j) / least))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def containment(shared: Column, a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) == 0, 0.0).otherwise(shared / F.least(a, b))


def verdict_by_signature(j: Column, a: Column, b: Column, same_title: Column) -> Column:
    """auto, gray, containment_check or none."""
    return (
        F.when(j >= AUTO, "auto")
        .when((j >= GRAY) | (same_title & (j >= TITLE)), "gray")
        .when(b.isNull() | a.isNull() | (F.least(a, b) < LEAST_SIZE), "none")
        .when(estimated_overlap(j, a, b) < 0.5, "none")
        .otherwise("containment_check")
    )


def verdict_exact(j: Column, contained: Column, smaller: Column, shared: Column, same_title: Column) -> Column:
    """auto, prompt, prompt_if_block or none."""
    return (
        F.when(j >= AUTO, "auto")
        .when((j >= GRAY) | (same_title & (j >= TITLE)) | ((smaller >= LEAST_SIZE) & (contained >= CONTAINED)), "prompt")
        .when(shared + 2 >= BLOCK_WORDS, "prompt_if_block")
        .otherwise("none")
    )


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common run, by extending matches along diagonals of sorted places."""
    if not len(a) or not len(b):
        return 0
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    low, high = np.searchsorted(sorted_b, a, "left"), np.searchsorted(sorted_b, a, "right")
    count = high - low
    if not count.sum():
        return 0
    i = np.repeat(np.arange(len(a)), count)
    within = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    j = order[np.repeat(low, count) + within]
    key = np.sort((i - j + len(b)).astype(np.int64) * (len(a) + len(b) + 2) + i)
    breaks = np.flatnonzero(np.diff(key) != 1)
    return int(np.diff(np.concatenate([[-1], breaks, [len(key) - 1]])).max())


@F.pandas_udf(T.IntegerType())
def shared_block_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of the longest block that two shingle sequences share: 0, or the run plus two."""
    runs = [longest_run(np.asarray(x, np.int64), np.asarray(y, np.int64)) for x, y in zip(a, b, strict=True)]
    return pd.Series([r + 2 if r else 0 for r in runs], dtype="int32")


def signatures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with names (set), n_shingles and signature."""
    named = with_shingles(df, text, "__shingles").select("*", F.explode(F.array(shingle_set(F.col("__shingles")))).alias("names")).drop("__shingles")
    return named.withColumn("n_shingles", F.size("names")).withColumn("signature", minhash("names"))


