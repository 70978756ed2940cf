import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmill.functions import postings
from clipmill.functions import shingles as S
from clipmill.operators import neardup
from clipmill.plans import neardup_queries
from clipmill.session import CLEANUP, stored

CALLS = "a long, b long"


def shuffle_files(spark) -> int:
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(name.startswith("shuffle_") for path in top for _, _, names in os.walk(path) for name in names)


def test_stored_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    made = stored(rows)
    until = time.time() + 5
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP) == "false"
    assert made.count() == 7


def test_packed_postings_are_small():
    rng = np.random.default_rng(3)
    names, ids = rng.integers(0, 1 << 64, 1 << 21, np.uint64), np.repeat(np.arange(1 << 12, dtype=np.uint64), 1 << 9)
    batch = postings.buckets(ids, names)
    sent = sum(len(x.as_py()) for c in ("names", "ids") for x in batch.column(c))
    assert sent < 8 * len(names)


@pytest.mark.parametrize(("chunk", "slices"), ((128, 32), (2, 1), (2, 32)))
def test_measures_of_pairs_in_tiles(spark, monkeypatch, chunk, slices):
    """A hub that all others meet, pairs of strangers, an empty array; chunks of one document at least."""
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "MOST_SLICES", slices)
    rng = random.Random(2)
    items = {i: rng.sample(range(90), rng.randint(1, 60)) for i in range(40)} | {40: []}
    pairs = sorted({(0, b) for b in range(1, 41)} | {tuple(sorted(rng.sample(range(41), 2))) for _ in range(200)})
    rows = stored(spark.createDataFrame(list(items.items()), "id long, items array<long>"))
    got = neardup.of_pairs(stored(spark.createDataFrame(pairs, CALLS)), rows, neardup.common, "int", np.sort)
    assert sorted(map(tuple, got.collect())) == [(a, b, len(set(items[a]) & set(items[b]))) for a, b in pairs]


def test_a_document_goes_once_to_a_tile(spark, monkeypatch):
    """Of 60 documents that are all alike one tile makes all 1,770 comparisons."""
    seen = []
    whole = neardup.stored

    def watched(df):
        out = whole(df)
        if out.columns == ["tile", "id"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stored", watched)
    rows = stored(spark.createDataFrame([(i, list(range(i, i + 50))) for i in range(60)], "id long, items array<long>"))
    pairs = stored(spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], CALLS))
    assert neardup.of_pairs(pairs, rows, neardup.common, "int", np.sort).count() == 1770
    assert seen == [60]


def test_pairs_are_the_same_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(25)]
    texts += [" ".join(t.split()[: rng.randint(1, 80)] + rng.choices(words, k=rng.randint(0, 20))) for t in texts for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "x/y" if i % 3 else "") for i, t in enumerate(texts)], "id long, text string, title string")
    one = sorted(map(tuple, neardup.exact_pairs(docs, title="title").collect()))
    monkeypatch.setattr(neardup, "PART", 100)
    assert sorted(map(tuple, neardup.exact_pairs(docs, title="title").collect())) == one and one


def test_share_of_equal_lanes():
    a, b = np.arange(128), np.arange(128)
    b[:5] = -1
    assert S.equal_lanes(a, b) == 123 / 128


def test_conflicts_search_pairs_once(spark, monkeypatch):
    calls, search = [], neardup.class_pairs
    monkeypatch.setattr(neardup, "class_pairs", lambda *a, **k: calls.append(1) or search(*a, **k))
    neardup_queries.kept_both_conflicts(spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 1


def test_estimates_sign_only_documents_of_pairs(spark, monkeypatch):
    signed, sign = [], S.signatures
    monkeypatch.setattr(S, "signatures", lambda df: signed.append(df.count()) or sign(df))
    found = neardup_queries.signature_estimates(spark, "/root/testdata/sf0.001").collect()
    assert signed == [len({i for r in found for i in (r.a, r.b)})]


def test_names_are_packed_in_two_halves(spark, monkeypatch):
    """Each half of the names is shuffled by itself; the sets are those of one go."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(30))) for i in range(20)], "id long, text string")
    made = []
    for most in (1 << 24, 0):
        monkeypatch.setattr(neardup, "WHOLE", most)
        seen, whole = [], stored
        monkeypatch.setattr(neardup, "stored", lambda df, seen=seen, whole=whole: seen.append(df.columns) or whole(df))
        names, sets, _ = neardup.classes(docs)
        made.append({(r.id, r.alone, tuple(sorted(r.rare))) for r in neardup.ranked_sets(names, sets).collect()})
        assert seen.count(["id", "s", "df"]) == (2 if not most else 1)
    assert made[0] == made[1]
