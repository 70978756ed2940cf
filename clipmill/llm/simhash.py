"""SimHash near-duplicates by a Gray-order hierarchical index.

1. Fingerprints per text (Arrow UDF): one or more 64-bit words, the first the
   plain SimHash, each further one that of remixed shingle hashes.
2. Distinct fingerprints only: copies meet in a map-side combined aggregate.
3. Each word is read under four rotations, so that each of its 16-bit blocks is
   once on top, and the fingerprints are sorted by the Gray rank of the rotated
   word. Words that agree on the top block are one run of that order, and words
   with at most three differing bits agree on one of four blocks.
4. The order is cut into ranges by pivots from a bounded sample. The pivots fix
   the leading bits of each range: the uppermost nodes. A fingerprint goes to its
   own range, and as a query to each later range of its run whose node it fits,
   so a hot run is many tasks and none compares parts with parts.
5. In a range every link is found by walking the index: nodes over runs of
   members keep the bits on which all agree, bits that a parent keeps are factored
   out of its children. A query goes down with the differences it has accumulated
   and drops a whole group once they pass the bound, once the top block differs,
   or once the whole group already is in the query's component.
6. Links leave a task as a spanning forest, never as all pairs, and alternating
   stars over the forest edges give the components.

``near_duplicates`` links one-word fingerprints of three-word shingles at three
bits. ``keep_one`` takes sets of five-word shingles: fingerprints of eight words,
whose 32 orders propose pairs, and an exact Jaccard similarity of 0.8 decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.neardup import common, of_pairs
from .common import KEY, cut, give_back, key_of, remove, stored, stored_at

DISTANCE = 3
SEED = 42
BLOCKS, BLOCK = 4, 16
FAN = 8
TOP = np.uint64(0xFFFF << 48)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints in a range, at most so many ranges in an order, sampled fingerprints for each pivot.
SPAN, MOST_RANGES, PER_PIVOT = 1 << 16, 4096, 32
#: Of the stage: shingle words, fingerprint words, similarity as a fraction.
WORDS, WIDTH = 5, 8
OVER, UNDER = 4, 5
#: Differing bits at which a pair is proposed: in the word of the order, in all words; and those that are tried first.
IN_WORD, IN_ALL, SURE = 18, 96, 64
#: Shingle hashes that go to the tiles of pairs at a time, even if the sets are fewer.
SLICE = 1 << 23
STARTS = np.arange(WIDTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


# --- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ASCII-lower-cased words; fewer words make one shingle, none give none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest, n = xxhash.xxh64_intdigest, len(parts) - k + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def sketch(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """Words of the fingerprint: a bit is 1 if it is set in over half the hashes; without hashes all are zero."""
    counts = np.zeros(64 * width, np.int64)
    step = 1 << 14
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        x = part[:, None] + STARTS[:width]  # a 64-bit finaliser, with another start for each further word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide = x ^ (x >> np.uint64(31))
        wide[:, 0] = part
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over word shingles with repeats; fewer words make one shingle, none give zero."""
    return int(sketch(shingle_hashes(text, words))[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    give_back()
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


# --- the index ------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def rotated(word: np.ndarray, block: int) -> np.ndarray:
    """``word`` with its ``block``-th block from above on top."""
    s = BLOCK * block
    return word if not s else (word << np.uint64(s)) | (word >> np.uint64(64 - s))


class GrayIndex:
    """Nodes over runs of ``FAN`` children; the members in Gray order are the lowest level.

    ``levels[k]`` is (own, value): the bits that the node keeps beyond its
    parent's, and their values. A member's own bits are all that its leaf's
    pattern leaves open.
    """

    def __init__(self, sorted_values: np.ndarray):
        self.values = sorted_values
        masks, values = [np.full(len(sorted_values), FULL)], [sorted_values]
        while len(masks[-1]) > 1:
            m, v = masks[-1], values[-1]
            at = np.arange(0, len(m), FAN)
            both = np.bitwise_and.reduceat(m, at)
            differ = np.bitwise_or.reduceat(v, at) ^ np.bitwise_and.reduceat(v, at)
            masks.append(both & ~differ)
            values.append(v[at])
        own = [masks[k] & ~np.repeat(masks[k + 1], FAN)[: len(masks[k])] for k in range(len(masks) - 1)] + [masks[-1]]
        self.levels = list(zip(own, values, strict=True))[::-1]

    def search(self, queries: np.ndarray, distance: int = DISTANCE, most: int = 1 << 20, top: np.uint64 = np.uint64(0), after: np.ndarray | None = None, groups: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query place, member place) of all links. The frontier is split when it grows past ``most``.

        No bit of ``top`` may differ. ``after``: per query, only members beyond
        this place are asked for. ``groups``: of the members and of the queries;
        only members of another group are asked for.
        """
        n, bottom = len(self.values), len(self.levels) - 1
        uniform = []
        if groups is not None:
            low = high = groups[0]
            uniform = [(low, high)]
            while len(low) > 1:
                at = np.arange(0, len(low), FAN)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
                uniform.append((low, high))
            uniform = uniform[::-1]
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int16))]
        while stack:
            level, q, node, seen = stack.pop()
            if len(q) > most:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], seen[:half]), (level, q[half:], node[half:], seen[half:])]
                continue
            own, value = self.levels[level]
            differ = (queries[q] ^ value[node]) & own[node]
            seen = seen + np.bitwise_count(differ)
            keep = (seen <= distance) & ((differ & top) == 0)
            if after is not None:
                keep &= np.minimum((node + 1) * FAN ** (bottom - level), n) - 1 > after[q]
            if groups is not None:
                low, high = uniform[level]
                keep &= (low[node] != groups[1][q]) | (high[node] != groups[1][q])
            q, node, seen = q[keep], node[keep], seen[keep]
            if not len(q):
                continue
            if level == bottom:
                yield q, node
                continue
            below = len(self.levels[level + 1][0])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = child < below
            stack.append((level + 1, np.repeat(q, FAN)[inside], child[inside], np.repeat(seen, FAN)[inside]))


def flat(parent: np.ndarray) -> np.ndarray:
    """``parent`` with each place at its root, in place."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def join_trees(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the trees of each a[i] and b[i]; gives the links that did so, a spanning forest of the given ones."""
    left, used = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        ra, rb = flat(parent)[a[left]], parent[b[left]]
        apart = ra != rb
        left, ra, rb = left[apart], ra[apart], rb[apart]
        if not len(left):
            return np.concatenate(used)
        upper, first = np.unique(np.maximum(ra, rb), return_index=True)  # one link for each larger root: no circles
        parent[upper] = np.minimum(ra, rb)[first]
        used.append(left[first])


class Order:
    """One of the sorted orders: a word under a rotation, and the pivots that cut its Gray ranks into ranges."""

    def __init__(self, place: int, pivots: np.ndarray):
        self.word, self.block = divmod(place, BLOCKS)
        self.pivots = pivots
        low = np.concatenate([[np.uint64(0)], pivots]).astype(np.uint64)
        high = np.append(pivots - np.uint64(1), FULL).astype(np.uint64)
        differ = low ^ high
        for s in (1, 2, 4, 8, 16, 32):
            differ = differ | (differ >> np.uint64(s))
        self.mask = ~differ  # leading bits that all ranks of the range share, and so all their codes
        self.value = (low ^ (low >> np.uint64(1))) & self.mask

    def values(self, words: np.ndarray) -> np.ndarray:
        return rotated(words[:, self.word], self.block)

    def own(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pivots, gray_rank(values), side="right")

    def later(self, values: np.ndarray, own: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, range) of the later ranges that hold a part of the row's run and whose node it fits."""
        end = np.searchsorted(self.pivots, gray_rank(values) | ~TOP, side="right")
        rows, at = np.flatnonzero(end > own), own[end > own]
        while len(rows):
            at = at + 1
            fits = np.bitwise_count((values[rows] ^ self.value[at]) & self.mask[at]) <= distance
            yield rows[fits], at[fits]
            more = end[rows] > at
            rows, at = rows[more], at[more]


TASK = "part int, query boolean, id long, root long, words binary"


def as_words(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def router(orders: list[Order], width: int, distance: int):
    """The function that deals fingerprints (id, root, words) out to ranges, as members and as queries."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = as_words(batch.column("words"), width)
            for k, order in enumerate(orders):
                values = order.values(words)
                own = order.own(values)
                everything = [(np.arange(len(own)), own, False), *((rows, at, True) for rows, at in order.later(values, own, distance))]
                for rows, at, query in everything:
                    if not len(rows):
                        continue
                    part = pa.array((k * MOST_RANGES + at).astype(np.int32))
                    kept = batch.select(["id", "root", "words"]).take(pa.array(rows))
                    yield pa.record_batch([part, pa.array(np.full(len(rows), query)), *kept.columns], names=["part", "query", "id", "root", "words"])

    return deal


def range_links(values: np.ndarray, words: np.ndarray, query: np.ndarray, roots: np.ndarray | None, distance: int, bounds: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one range as pairs of rows.

    Without ``roots`` a spanning forest of all links, made of those within the
    first of ``bounds`` as far as they reach; with ``roots`` all links between
    rows of different roots.
    """
    members, foreign = np.flatnonzero(~query), np.flatnonzero(query)
    if not len(members):
        return
    members = members[np.argsort(gray_rank(values[members]), kind="stable")]
    index, n = GrayIndex(values[members]), len(members)
    rows = np.concatenate([members, foreign])
    place = np.where(np.arange(len(rows)) < n, np.arange(len(rows)), -1)
    parent = np.arange(len(rows)) if roots is None else None
    step = max(1 << 13, len(rows) // 8)

    def near(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
        return np.bitwise_count(words[rows[a]] ^ words[rows[b]]).sum(1, dtype=np.int64) <= bound

    for bound in bounds if roots is None else bounds[-1:]:
        if roots is None and n > 1:  # neighbours in Gray order first: they join most of a large group
            a = np.arange(n - 1)
            a = a[near(a, a + 1, bound)]
            used = join_trees(parent, a, a + 1)
            yield rows[a[used]], rows[a[used] + 1]
        for start in range(0, len(rows), step):
            asked = np.arange(start, min(start + step, len(rows)))
            labels = roots[rows] if roots is not None else flat(parent).copy()
            for q, m in index.search(values[rows[asked]], min(distance, bound), top=TOP, after=place[asked], groups=(labels[:n], labels[asked])):
                q = asked[q]
                fits = (m > place[q]) & (labels[q] != labels[m])
                q, m = q[fits], m[fits]
                fits = near(q, m, bound)
                q, m = q[fits], m[fits]
                if roots is None:
                    used = join_trees(parent, q, m)
                    q, m = q[used], m[used]
                yield rows[q], rows[m]


def searcher(orders: list[Order], width: int, distance: int, bounds: tuple[int, ...], rooted: bool):
    """The function over rows sorted by range; each range is searched once it is whole."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            words = as_words(table.column("words"), width)
            ids, query = table.column("id").to_numpy(), table.column("query").to_numpy()
            values = orders[table.column("part")[0].as_py() // MOST_RANGES].values(words)
            roots = table.column("root").to_numpy() if rooted else None
            for a, b in range_links(values, words, query, roots, distance, bounds):
                if len(a):
                    yield pa.record_batch([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if kept and e > s and kept[-1].column("part")[0].as_py() != part[s]:
                    yield from emit(pa.Table.from_batches(kept))
                    kept = []
                if e > s:
                    kept.append(batch.slice(s, e - s))
        if kept:
            yield from emit(pa.Table.from_batches(kept))
        del kept
        give_back()

    return search


def pivots(nodes: DataFrame, width: int) -> list[Order]:
    """The orders with their pivots, from a sample of ``PER_PIVOT`` fingerprints for each range."""
    total = nodes.count()
    ranges = min(max(1, -(-total // SPAN)), MOST_RANGES)
    sample = np.zeros((0, width), np.uint64)
    if ranges > 1:
        share = min(1.0, PER_PIVOT * ranges / total)
        rows = nodes.filter(F.xxhash64("id", F.lit(1)).bitwiseAND((1 << 40) - 1) < int(share * (1 << 40))).select("words").collect()
        sample = np.frombuffer(b"".join(bytes(r.words) for r in rows), "<u8").reshape(-1, width)
    orders = []
    for k in range(width * BLOCKS):
        ranks = np.sort(gray_rank(rotated(sample[:, k // BLOCKS], k % BLOCKS)))
        at = np.arange(1, ranges) * len(ranks) // ranges if len(ranks) else np.zeros(0, np.int64)
        found = np.unique(ranks[at])
        orders.append(Order(k, found[found > 0]))
    return orders


def index_links(nodes: DataFrame, width: int, distance: int, bounds: tuple[int, ...], rooted: bool = False) -> DataFrame:
    """Links (a, b) between ids of ``nodes`` (id, root, words: distinct fingerprints); see ``range_links``."""
    orders = pivots(nodes, width)
    tasks = nodes.select("id", "root", "words").mapInArrow(router(orders, width, distance), TASK)
    tasks = tasks.repartition("part").sortWithinPartitions("part")
    return tasks.mapInArrow(searcher(orders, width, distance, bounds, rooted), "a long, b long")


@F.pandas_udf(T.BinaryType())
def word_bytes(words: pd.Series) -> pd.Series:
    return pd.Series([w.tobytes() for w in words.to_numpy(np.int64).astype("<i8")])


def candidate_links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) of a graph on column ``fp`` whose components are those of all links."""
    nodes = distinct.select(F.col("fp").alias("id"), F.col("fp").alias("root"), word_bytes("fp").alias("words"))
    return index_links(nodes, 1, DISTANCE, (DISTANCE,))


# --- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b); the root is the smallest node of the component.

    Alternating large and small stars; each turn is written and the loop
    ends when a turn leaves the edges as they were. The aggregates are written
    before they are joined back, so that the rows of a hot node can be split.
    """
    spark = edges.sparkSession
    path, edges = stored_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, (path, edges) = path, stored_at(small.filter("a <> b").distinct())
        remove(spark, old)
        now = state(edges)
        if now == was:
            break
        was = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def linked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: KEY, doc_id, fp, root (of the component) and component_id."""
    marked = cut(df.select(*key_of(id_col, text_col), F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(candidate_links(distinct))
    rooted = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id (smallest id reachable).

    A null text counts as empty and empty texts have fingerprint zero, linked like
    any other. Null ids never name a component unless it has no other id; repeated
    rows share theirs. An empty table gives no rows.
    """
    return linked(df, id_col, text_col).select("doc_id", "fp", "component_id")


# --- sets of five-word shingles -------------------------------------------------------------------


@F.pandas_udf(T.StructType([T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), T.StructField("words", T.BinaryType())]))
def classes_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The class of each text (a hash of its set of shingles), the size of the set and its fingerprint."""
    for texts in batches:
        rows = []
        for text in texts:
            names = np.unique(shingle_hashes(text, WORDS))
            rows.append((np.uint64(xxhash.xxh3_64_intdigest(names.tobytes())).view(np.int64), len(names), sketch(names, WIDTH).tobytes()))
        yield pd.DataFrame(rows, columns=["c", "n", "words"])
        give_back()


@F.pandas_udf(T.ArrayType(T.LongType()))
def names_of(texts: pd.Series) -> pd.Series:
    give_back()
    return pd.Series([np.unique(shingle_hashes(t, WORDS)).view(np.int64) for t in texts])


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """1 if two sorted sets have the similarity, else 0."""
    shared = common(a, b)
    return int((len(a) + len(b) - shared) * OVER <= shared * UNDER)


def verified(pairs: DataFrame, classes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have the similarity; only texts of the pairs are read.

    A set goes once to each tile of pairs, not once to each pair.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    keys = cut(classes.select("c", *KEY).join(wanted, "c", "left_semi"))
    keyed = df.select(*key_of(id_col, text_col), F.col(text_col).alias("text"))
    path, sets = stored_at(keyed.join(keys, list(KEY)).dropDuplicates(["c"]).select(F.col("c").alias("id"), names_of("text").alias("items")))
    rated = of_pairs(pairs, sets, alike, "int", np.sort, SLICE)
    remove(df.sparkSession, path)
    return rated.filter("value = 1").select("a", "b")


def similar_links(classes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between classes whose components are those of all similar pairs that the index proposes.

    A forest of the proposed pairs is verified first. Where every link of it
    holds, no other pair can join anything. In the components where one fails,
    all proposed pairs between classes still apart are verified too.
    """
    own = classes.select("c", "words")
    heads = cut(own.groupBy("words").agg(F.min("c").alias("id")))
    same = own.join(heads, "words").filter("c <> id").select(F.col("c").alias("a"), F.col("id").alias("b"))
    found = index_links(heads.withColumn("root", F.col("id")), WIDTH, IN_WORD, (SURE, IN_ALL))
    proposed = stored(found.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    held = stored(verified(proposed, classes, df, id_col, text_col))
    if held.count() == proposed.count():
        return held
    loose = components(proposed).withColumnRenamed("root", "loose")
    tight = components(held)
    named = cut(loose.join(tight, "node", "left").select("node", "loose", F.coalesce("root", "node").alias("root")))
    broken = cut(named.groupBy("loose").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("loose"))
    nodes = cut(named.join(broken, "loose", "left_semi").select(F.col("node").alias("id"), "root").join(own.withColumnRenamed("c", "id"), "id"))
    rest = index_links(nodes, WIDTH, IN_WORD, (IN_ALL,), rooted=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = stored(rest.join(proposed, ["a", "b"], "left_anti"))
    return held.unionByName(verified(rest, classes, df, id_col, text_col))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: KEY and root, which rows of one group of near-duplicates share.

    Links are pairs of texts whose sets of five-word shingles (fewer words: the
    whole sequence) have a Jaccard similarity of 0.8 or more; texts without words
    are one group. A null text counts as empty; repeated rows share their root;
    whole texts of any length are read; an empty table gives no rows.
    """
    marked = stored(df.select(*key_of(id_col, text_col), classes_of(F.col(text_col)).alias("p")).select(*KEY, "p.*"))
    classes = stored(marked.filter("n > 0").groupBy("c").agg(F.min(F.struct(*KEY)).alias("k"), F.min("words").alias("words")).select("c", "k.*", "words"))
    roots = components(similar_links(classes, df, id_col, text_col)).withColumnRenamed("node", "c")
    return marked.select(*KEY, "c").join(roots, "c", "left").select(*KEY, F.coalesce("root", "c").alias("root"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, one of each group of ``similar``: that of the smallest id (null last, then by text).

    Of rows that repeat the kept id and text exactly one stays. All columns stay,
    whatever their names.
    """
    kept = cut(similar(df, id_col, text_col).groupBy("root").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*"))
    packed = df.select(F.struct("*").alias("row"), *key_of(id_col, text_col))
    same = Window.partitionBy(*KEY).orderBy("mark")
    return packed.join(kept, list(KEY), "left_semi").withColumn("n", F.row_number().over(same)).filter("n = 1").select("row.*")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
