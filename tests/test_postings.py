import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmill.functions import postings
from clipmill.operators import neardup
from clipmill.session import freed, stored


def test_packed_postings_come_back(spark):
    """Names over the whole range, of few and many documents, packed by several tasks."""
    rng = random.Random(5)
    few = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    sets = {i - 20: rng.sample(few, rng.randint(0, 40)) for i in range(60)}
    df = Counter(s for x in sets.values() for s in x)
    rows = spark.createDataFrame(list(sets.items()), "id long, names array<long>").repartition(3)
    got = rows.mapInArrow(postings.packed, postings.PACKED).groupBy("bucket").applyInArrow(postings.shared, postings.SHARED).collect()
    assert sorted(map(tuple, got)) == sorted((i, s, df[s]) for i, x in sets.items() for s in x if df[s] > 1)


def test_packed_postings_take_seven_bytes_of_content():
    rng = np.random.default_rng(3)
    names, ids = rng.integers(0, 1 << 64, 1 << 20, np.uint64), np.repeat(np.arange(1 << 10, dtype=np.uint64), 1 << 10)
    batch = postings.buckets(ids, names)
    gaps = np.concatenate([postings.whole(x.as_py()) for x in batch.column("names")])
    assert np.count_nonzero(gaps >> np.uint64(48)) < len(gaps) / 50


@pytest.mark.parametrize("most", (1, 7))
def test_overlaps_in_slices(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_SLICES", most)
    sets = stored(spark.createDataFrame([(i, "", 60, 0, list(range(i, i + 60))) for i in range(20)], "id long, title string, n int, alone int, rare array<long>"))
    pairs = stored(spark.createDataFrame([(a, b) for b in range(20) for a in range(b)], "a long, b long"))
    got = {(r.a, r.b): r.shared for r in neardup.overlaps(pairs, sets).collect()}
    assert got == {(a, b): 60 - (b - a) for b in range(20) for a in range(b)}


def test_freed_folders_go(spark):
    df = stored(spark.range(3))
    path = df.inputFiles()[0]
    freed(spark, df)
    with pytest.raises(Exception):
        spark.read.parquet(path).agg(F.count("*")).first()
