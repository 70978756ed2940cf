"""Line de-duplication by a suffix array over line-id sequences.

A text is the sequence of the ids of its lines that hold words. A run of lines
with at least ``min_words`` words that occurs again, anywhere later in the corpus
(order: id, then place), loses its later copies.

1. Lines that occur once can't be in a repeated run, nor can stretches of the other
   lines that have too few words. What stays is a fraction of the corpus, as narrow
   rows: a suffix is its place (number of the text, place of the line).
2. Prefix doubling: the rank of the first 2k lines of a suffix is the place, in
   sorted order, of the pair of ranks of its two halves of k lines. A round joins
   each suffix with the one k places on, sorts the distinct pairs by range and
   numbers them. Suffixes whose first lines occur once leave the rounds.
3. Suffixes of equal rank are an interval of the suffix array with that longest
   common prefix at least. Going down from the longest ranks, intervals are split:
   those members of an interval that share a further rank form an inner interval
   with a longer prefix, and stand in the outer one by their first member alone. So
   each suffix gets the longest prefix that it shares with any earlier suffix: the
   maximal repeated run from its place on.
4. Runs of enough words go, joined per text. The first place of a run stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, WORD, cut, key_of, let, numbered, stored

SHIFT = 31  # bits of a place within its text


def suffixes(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): places p of lines that may be in a repeated run, with x, y, words and the words from there to the end of their stretch; numbers of texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    element = lambda line: F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(7), line).alias("y"), F.regexp_count(line, F.lit(WORD)).alias("words"))
    placed = F.filter(F.transform(F.split(text, "\n", -1), element), lambda e: e["words"] > 0)
    texts = cut(df.select(*key_of(id_col, text_col), placed.alias("lines")))
    rows = texts.select(*KEY, F.posexplode("lines").alias("place", "line")).select(*KEY, "place", "line.*")
    often = cut(rows.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select("x", "y"))
    kept = rows.join(often, ["x", "y"], "left_semi").dropDuplicates([*KEY, "place"])
    order = Window.partitionBy(*KEY).orderBy("place")
    stretch = Window.partitionBy(*KEY, "stretch")
    marked = kept.withColumn("stretch", F.col("place") - F.row_number().over(order))
    long_enough = marked.withColumn("total", F.sum("words").over(stretch)).filter(F.col("total") >= min_words)
    onward = stretch.orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = stored(long_enough.withColumn("onward", F.sum("words").over(onward)).select(*KEY, "place", "x", "y", "words", "onward"))
    numbers = stored(numbered(found.select(*KEY).distinct(), list(KEY), "doc"))
    at = F.shiftleft(F.col("doc"), SHIFT) + F.col("place")
    return stored(found.join(numbers, list(KEY)).select(at.alias("p"), "x", "y", "words", "onward")), numbers


def doubled_ranks(rows: DataFrame) -> list[DataFrame]:
    """Tables (p, r): ranks of the first 1, 2, 4, ... lines of the suffixes that share them with another."""

    def ranked(pairs: DataFrame) -> DataFrame:
        shared = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
        return stored(pairs.join(numbered(shared, ["a", "b"], "r"), ["a", "b"]).select("p", "r"))

    levels = [ranked(rows.select("p", F.col("x").alias("a"), F.col("y").alias("b")))]
    while levels[-1].limit(1).count():
        last, k = levels[-1], 1 << (len(levels) - 1)
        second = last.select((F.col("p") - k).alias("p"), F.col("r").alias("b"))
        levels.append(ranked(stored(last.withColumnRenamed("r", "a").join(second, "p"))))
    return levels[:-1]


def longest_earlier(rows: DataFrame, levels: list[DataFrame], min_words: int) -> DataFrame:
    """(p, m): most lines from place p on that also stand at an earlier place.

    An interval is named by its first member ``f`` and its prefix length ``m``; the
    outermost has neither.
    """
    state = rows.filter(F.col("onward") >= min_words).select("p", F.lit(-1).cast("bigint").alias("f"), F.lit(0).cast("bigint").alias("m"))
    found = []
    for k in reversed(range(len(levels))):
        ahead = levels[k].select(F.col("p").alias("q"), "r")
        looked = stored(state.withColumn("q", F.col("p") + F.col("m")).join(ahead, "q", "left").select("p", "f", "m", "r"))
        inner = looked.filter("r IS NOT NULL").groupBy("f", "m", "r").agg(F.min("p").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        inner = cut(inner)
        split = stored(looked.join(inner, ["f", "m", "r"], "left").select("p", "f", "m", "first"))
        deeper = split.filter("first IS NOT NULL").select("p", F.col("first").alias("f"), (F.col("m") + (1 << k)).alias("m"))
        found.append(deeper.filter("p > f").select("p", "m"))
        state = deeper.unionByName(split.filter("first IS NULL OR first = p").select("p", "f", "m"))
    if not found:
        return state.select("p", "m").filter("m > 0")
    return functools.reduce(DataFrame.unionByName, found).groupBy("p").agg(F.max("m").alias("m"))


def repeated(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """KEY and ``gone``: places, among a text's lines with words, that belong to later copies."""
    rows, numbers = suffixes(df, id_col, text_col, min_words)
    runs = longest_earlier(rows, doubled_ranks(rows), min_words)
    ends = rows.select(F.col("p").alias("last"), (F.col("onward") - F.col("words")).alias("after"))
    sized = runs.join(rows.select("p", "onward"), "p").withColumn("last", F.col("p") + F.col("m") - 1).join(ends, "last")
    whole = sized.filter(F.col("onward") - F.col("after") >= min_words).select(F.shiftright("p", SHIFT).alias("doc"), F.col("p").alias("first"), "last")
    order = Window.partitionBy("doc").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = whole.withColumn("fresh", F.when(F.coalesce(F.col("first") > reach + 1, F.lit(True)), 1).otherwise(0))
    parts = opened.withColumn("part", F.sum("fresh").over(order)).groupBy("doc", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    place = lambda p: F.col(p).bitwiseAND((1 << SHIFT) - 1).cast("int")
    gone = parts.groupBy("doc").agg(F.flatten(F.collect_list(F.sequence(place("first"), place("last")))).alias("gone"))
    return gone.join(numbers, "doc").select(*KEY, "gone")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """All rows as struct ``row`` with text (later copies deleted), n_lines and n_deleted.

    Lines are compared as they are; lines without words belong to no run and stay.
    A null text has no lines and stays null. Rows that repeat id and text are one
    text and keep the same lines. Texts with null ids come last in the order. A text
    is read whole, whatever its length; an empty table gives no rows.
    """
    gone = repeated(df, id_col, text_col, min_words)
    packed = df.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), *key_of(id_col, text_col))
    joined = packed.join(gone, list(KEY), "left")
    lines = F.split(F.col("text"), "\n", -1)

    def thinned(all_lines: Column) -> Column:
        indexed = F.filter(F.transform(all_lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["x"].rlike(WORD))
        dead = let(indexed, lambda rows: F.transform(F.col("gone"), lambda p: F.get(rows, p)["i"]))
        alive = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), dead)
        return F.array_join(F.transform(alive, lambda i: F.get(all_lines, i)), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, thinned))
    total = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(WORD))), F.lit(0))
    return joined.select("row", text.alias("text"), total.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
placed AS (
  SELECT doc_id, i, lines[i] AS line, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS words
  FROM texts, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
seq AS (
  SELECT *, row_number() OVER w AS p, sum(words) OVER w AS upto FROM placed WHERE words > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
arrays AS (SELECT doc_id, list(line ORDER BY p) AS all_lines FROM seq GROUP BY doc_id),
spans AS (
  SELECT a.doc_id, a.p AS first, min(b.p) AS last FROM seq a JOIN seq b
  ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY a.doc_id, a.p
  UNION
  SELECT b.doc_id, max(a.p) AS first, b.p AS last FROM seq a JOIN seq b
  ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.p),
named AS (
  SELECT s.doc_id, s.first, s.last, array_to_string(list_slice(r.all_lines, s.first, s.last), chr(10)) AS name
  FROM spans s JOIN arrays r USING (doc_id)),
later AS (
  SELECT doc_id, first, last FROM (
    SELECT *, min((doc_id, first)) OVER (PARTITION BY name) AS keep FROM named) q WHERE (doc_id, first) > keep),
gone AS (SELECT DISTINCT l.doc_id, s.i FROM later l JOIN seq s ON s.doc_id = l.doc_id AND s.p BETWEEN l.first AND l.last),
left_lines AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS text FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT t.doc_id,
       (SELECT count(*) FROM seq s WHERE s.doc_id = t.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = t.doc_id) AS n_deleted,
       CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text
FROM texts t LEFT JOIN left_lines l ON t.doc_id = l.doc_id
"""
