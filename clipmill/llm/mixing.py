"""Mixing sources to target weights by capped water-filling.

Targets: sources, in code-point order with null last, weigh 1, 2, 3, repeating,
and share all words. A source whose share passes ``max_epochs`` times its own
words is clamped there and the excess is reshared by weight; the loop ends when
no source is above. A clamp only depends on the water level, so each turn of the
loop is one aggregate over the table of sources and three numbers on the driver.

Sampling: a target is a number of whole repetitions of the source and a
remainder. The remainder is filled in the order of a seeded hash of the id. Two
histograms of hash digits (15 bits each) find the prefix where the running sum
crosses the remainder; of that prefix, 2^-30 of a source, rows are counted by
(hash, id, size) and only the counts are put in order. The rule for a row is then
a comparison with one bound of its source, so texts are never shuffled, and a
rerun takes the same rows.

Ties: of rows that share hash, id and size the remainder may take some. They are
told apart by a hash of their texts, again by counts; of rows equal in that too
the exact number is taken by their place in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

HASH_BITS, DIGIT = 60, 15
SMALL_TABLE = 100_000


def sizes(df: DataFrame, text_col: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def seeded(id_col: str, seed: int) -> F.Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code-point order, null last, without one task that sees all."""
    ordered = cut(sources.orderBy(F.col("source").asc_nulls_last()))
    ordered = cut(ordered.withColumn("mid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ordered.join(F.broadcast(offsets), "part").select("source", "source_size", (F.col("offset") + F.col("mid").bitwiseAND((1 << 33) - 1)).alias("rank"))


def water_level(caps: DataFrame, total: int) -> tuple[int, int]:
    """(words, weight) left over for the unclamped sources; their ratio is the level.

    ``caps`` has ``cap`` and ``weight``. The level only rises, so a clamped
    source stays clamped and the loop ends.
    """
    level, clamped = None, -1
    while True:
        under = F.lit(False) if level is None else F.col("cap") * level[1] < F.col("weight") * level[0]
        row = caps.agg(F.sum(F.when(under, F.col("cap")).otherwise(0)), F.sum(F.when(under, 0).otherwise(F.col("weight"))), F.count_if(under)).first()
        if row[2] == clamped or not row[1]:
            return level or (0, 1)
        level, clamped = (total - row[0], row[1]), row[2]


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row per source: source, source_size, target, whole, bound, and what the remainder takes of a tie."""
    base = cut(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), sizes(df, text_col).alias("size"), seeded(id_col, seed).alias("h"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")))
    sources = ranked(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    caps = cut(sources.select("source", "source_size", (F.col("source_size") * max_epochs).cast("decimal(38,0)").alias("cap"), (F.col("rank") % 3 + 1).cast("decimal(38,0)").alias("weight")))
    total = int(caps.agg(F.sum("source_size")).first()[0] or 0)
    words, weight = map(int, water_level(caps, total))
    share = F.col("weight").cast("double") * float(words) / float(weight)
    targets = cut(
        caps.withColumn("target", F.when(F.col("cap") * weight < F.col("weight") * words, F.col("cap").cast("double")).otherwise(share))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"))
    )
    keyed = base.select("doc_id", "size", "h", "mark", F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"))
    at = targets.select("key", "none", "rest", F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("prefix"))
    for level in (1, 2):
        at = cut(crossing(keyed, at, HASH_BITS - level * DIGIT))
    groups = within(keyed, at, HASH_BITS - 2 * DIGIT).filter("size > 0").groupBy("key", "none", "before", "rest", "h", "doc_id", "size").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("key", "none").orderBy("h", "doc_id", "size")
    run = groups.withColumn("prior", F.col("before") + F.sum(F.col("size") * F.col("m")).over(upto) - F.col("size") * F.col("m"))
    fit = F.greatest(F.lit(0), F.least(F.col("m"), F.floor((F.col("rest") - F.col("prior") - F.col("size") / 2) / F.col("size")).cast("bigint") + 1))
    run = cut(run.select("key", "none", F.struct("h", "doc_id", "size").alias("place"), "m", fit.alias("k")))
    last = run.filter("k = m").groupBy("key", "none").agg(F.max("place").alias("last"))
    split = run.filter("0 < k AND k < m").select("key", "none", F.col("place").alias("tie"), "k")  # one row of a source at most
    top = F.lit((1 << 63) - 1)
    floor = F.struct((F.shiftleft(F.col("prefix"), HASH_BITS - 2 * DIGIT) - 1).alias("h"), top.alias("doc_id"), top.alias("size"))
    bounds = at.join(last, ["key", "none"], "left").select("key", "none", F.coalesce("last", floor).alias("bound"))
    known = targets.join(bounds, ["key", "none"], "left").join(tied(keyed, cut(split)), ["key", "none"], "left")
    return cut(known.select("key", "none", "source_size", "target", "whole", "bound", "tie", "upto_mark", "in_mark", "in_count"))


def within(keyed: DataFrame, at: DataFrame, shift: int) -> DataFrame:
    """Rows of ``keyed`` that have their source's prefix."""
    return keyed.withColumn("prefix", F.shiftright("h", shift)).join(hint(at), ["key", "none", "prefix"])


def crossing(keyed: DataFrame, at: DataFrame, shift: int) -> DataFrame:
    """Per source the prefix, a digit longer than that of ``at``, where the running sum crosses ``rest``."""
    upto = Window.partitionBy("key", "none").orderBy("digit")
    bins = within(keyed, at, shift + DIGIT).groupBy("key", "none", "before", "rest", F.shiftright("h", shift).alias("digit")).agg(F.sum("size").alias("n"))
    bins = bins.withColumn("before", F.col("before") + F.sum("n").over(upto) - F.col("n"))
    return bins.filter("before <= rest AND rest < before + n").select("key", "none", F.col("digit").alias("prefix"), "before", "rest")


def tied(keyed: DataFrame, split: DataFrame) -> DataFrame:
    """Of sources whose remainder takes k rows of a tie: tie, the last text hash taken whole, the next one and how many of it."""
    rows = keyed.join(hint(split), ["key", "none"]).filter(F.struct("h", "doc_id", "size").eqNullSafe(F.col("tie")))
    upto = Window.partitionBy("key", "none").orderBy("mark")
    marks = rows.groupBy("key", "none", "tie", "k", "mark").agg(F.count("*").alias("m"))
    run = marks.withColumn("fit", F.greatest(F.lit(0), F.least(F.col("m"), F.col("k") - F.sum("m").over(upto) + F.col("m"))))
    some = F.when((F.col("fit") > 0) & (F.col("fit") < F.col("m")), F.struct("mark", "fit"))
    found = run.groupBy("key", "none").agg(F.first("tie").alias("tie"), F.max(F.when(F.col("fit") == F.col("m"), F.col("mark"))).alias("upto_mark"), F.max(some).alias("some"))
    return found.select("key", "none", "tie", "upto_mark", F.col("some.mark").alias("in_mark"), F.col("some.fit").alias("in_count"))


def hint(small: DataFrame) -> DataFrame:
    """Broadcast a checkpointed table with a row per source only if it is short."""
    return F.broadcast(small) if small.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else small


def by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(hint(sources), ["key", "none"])


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """All rows of ``df`` as struct ``row`` with size, source_size, target and copies.

    ``copies`` (0 to ``max_epochs``) says how often the mix repeats the row. Null
    texts have size 0; a null source is a source of its own, the last; null ids
    share one place in the order and are told apart by their texts; rows that
    repeat id, source and text are taken one by one, so a source misses its target
    by one row at most; an empty table gives none.
    """
    texts = F.coalesce(F.col(text_col), F.lit(""))
    packed = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), sizes(df, text_col).alias("size"), seeded(id_col, seed).alias("h"), F.xxhash64(texts).alias("mark"), F.coalesce(F.col(source_col), F.lit("")).alias("key"), F.col(source_col).isNull().alias("none"))
    known = plan(df, id_col, text_col, source_col, max_epochs, seed)
    joined = by_source(packed, known)
    place = F.struct("h", F.col("doc_id").cast("long").alias("doc_id"), "size")
    in_tie = F.col("tie").isNotNull() & place.eqNullSafe(F.col("tie"))
    below = F.coalesce(place <= F.col("bound"), F.lit(False)) | F.coalesce(in_tie & (F.col("mark") <= F.col("upto_mark")), F.lit(False))
    out = lambda rows, extra: rows.select("row", "doc_id", "size", "source_size", "target", (F.col("whole") + extra).alias("copies"))
    if not known.filter("in_count IS NOT NULL").limit(1).count():
        return out(joined, below.cast("long"))
    alike = F.coalesce(in_tie & (F.col("mark") == F.col("in_mark")), F.lit(False))
    return out(joined.filter(~alike), below.cast("long")).unionByName(out(placed(joined.filter(alike)), (F.col("nth") < F.col("in_count")).cast("long")))


def placed(rows: DataFrame) -> DataFrame:
    """``rows``, written, with ``nth`` from 0 in each source; no task numbers more than a partition of them."""
    rows = cut(rows).withColumn("mid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("key", "none").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("key", "none", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("key", "none", "part").orderBy("mid")
    return rows.withColumn("own", F.row_number().over(inside) - 1).join(counts.drop("n"), ["key", "none", "part"]).withColumn("nth", F.col("offset") + F.col("own"))


def expand(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as ``copies`` says."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM base GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS t FROM sources),
level AS (
  SELECT 0 AS turn, t AS words, (SELECT sum(weight) FROM sources)::BIGINT AS weight, -1::BIGINT AS clamped FROM total
  UNION ALL
  SELECT turn + 1, n.words, n.weight, n.clamped FROM (
    SELECT l.turn, l.clamped AS was,
           (SELECT t FROM total) - coalesce((SELECT sum(3 * source_size) FROM sources s WHERE 3 * source_size * l.weight < s.weight * l.words), 0)::BIGINT AS words,
           (SELECT sum(s.weight) FROM sources s WHERE NOT 3 * source_size * l.weight < s.weight * l.words)::BIGINT AS weight,
           (SELECT count(*) FROM sources s WHERE 3 * source_size * l.weight < s.weight * l.words) AS clamped
    FROM level l) n WHERE n.clamped <> n.was),
final AS (SELECT words, weight FROM level ORDER BY turn DESC LIMIT 1),
targets AS (
  SELECT s.source, source_size,
         CASE WHEN 3 * source_size * f.weight < s.weight * f.words THEN (3 * source_size)::DOUBLE
              ELSE s.weight::DOUBLE * f.words::DOUBLE / f.weight::DOUBLE END AS target
  FROM sources s, final f),
reps AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
run AS (
  SELECT b.doc_id, b.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM base b JOIN reps r ON b.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN prior + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
