import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmill.functions import shingles as S
from clipmill.operators import neardup

SIGNATURE = [
    (0.95, 100, 100, False, "auto"), (0.70, 100, 100, False, "auto"), (0.55, 100, 100, False, "gray"), (0.40, 100, 100, False, "gray"), (0.15, 500, 60, False, "containment_check"),
    (0.15, 500, 10, False, "none"), (0.15, 500, 500, False, "none"), (0.15, 500, None, False, "none"), (0.156, 158, 220, True, "gray"), (0.10, 100, 100, True, "gray"), (0.05, 100, 100, True, "none"),
    (0.2, 100, 100, False, "none"), (0.08, 500, 60, True, "containment_check"),
]
EXACT = [
    (0.85, 1.0, 100, 90, False, "auto"), (0.55, 0.6, 100, 60, False, "prompt"), (0.201, 0.4, 140, 56, True, "prompt"), (0.2, 0.9, 100, 90, False, "prompt"), (0.2, 0.9, 20, 18, False, "none"),
    (0.35, 0.66, 1348, 894, False, "prompt_if_block"), (0.05, 0.2, 1000, 200, False, "none"),
]


def test_verdicts(spark):
    a = spark.createDataFrame(SIGNATURE, "j double, a int, b int, t boolean, v string")
    assert all(r.v == r.got for r in a.withColumn("got", S.verdict_by_signature(F.col("j"), F.col("a"), F.col("b"), F.col("t"))).collect())
    b = spark.createDataFrame(EXACT, "j double, c double, s int, n int, t boolean, v string")
    assert all(r.v == r.got for r in b.withColumn("got", S.verdict_exact(F.col("j"), F.col("c"), F.col("s"), F.col("n"), F.col("t"))).collect())


def test_overlap_and_shingles(spark):
    df = spark.createDataFrame([(0.2, 50, 250), (0.0, 10, 20), (0.5, 0, 5)], "j double, a int, b int")
    assert [r[0] for r in df.select(S.estimated_overlap(F.col("j"), F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    texts = spark.createDataFrame([("Alpha, beta gamma delta!",), ("one two one two one",), ("a b",), ("",), (None,), ("-- ¿qué? 日本",)], "text string")
    got = [r[0] for r in S.with_shingles(texts).select("shingles").collect()]
    assert got == [["alpha beta gamma", "beta gamma delta"], ["one two one", "two one two", "one two one"], ["a", "b"], [], [], ["qué", "日本"]]


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 1000)
    for keep in (1000, 800, 500):
        other = np.concatenate([base[:keep], rng.integers(0, 1 << 60, 1000 - keep)])
        exact = keep / (2000 - keep)
        assert abs((S.signature_of(base) == S.signature_of(other)).mean() - exact) < 0.16
    assert (S.signature_of(np.zeros(0, np.int64)) == S.EMPTY).all()


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_longest_run():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert S.longest_run(np.array(a, np.int64), np.array(b, np.int64)) == longest(a, b)


def test_exact_pairs_lose_nothing(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 120))] for _ in range(25)]
    texts = [list(rng.choice(base)) for _ in range(80)]
    for t in texts:
        for _ in range(rng.randint(0, len(t) // 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
    texts = [" ".join(["the usual boilerplate starts here", *t[: rng.randint(1, len(t))]]) for t in texts]
    titles = [rng.choice(["t1", "t2", ""]) for _ in texts]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, titles))], "id long, text string, title string")
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (t.split() for t in texts)]
    for title in (None, "title"):
        expected = {}
        for a in range(80):
            for b in range(a + 1, 80):
                shared = len(sets[a] & sets[b])
                j, least = shared / len(sets[a] | sets[b]), min(len(sets[a]), len(sets[b]))
                same = bool(title) and titles[a] == titles[b] != ""
                if shared and (j >= 0.7 or j >= 0.4 or (same and j >= 0.1) or (least >= 48 and shared / least >= 0.8)):
                    expected[a, b] = (shared, "auto" if j >= 0.7 else "prompt")
        assert {(r.a, r.b): (r.shared, r.verdict) for r in neardup.exact_pairs(df, title=title).collect()} == expected


@pytest.mark.parametrize("seed, most", [(1, 1 << 20), (2, 1 << 20), (1, 3), (2, 0)])
def test_forest_is_that_of_the_visiting_order(spark, seed, most):
    """By one task a component, and by rounds over components that are too large for one."""
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)})
    parent = list(range(30))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    old = [(0, 1), (2, 3)]
    for a, b in old:
        parent[find(a)] = find(b)
    expected = set()
    for a, b in sorted(edges, key=lambda e: (e[1], -e[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            expected.add((a, b))
    got = neardup.spanning_forest(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(old, "a long, b long"), most)
    assert {(r.a, r.b) for r in got.collect()} == expected


def test_scan_by_classes_links_as_all_pairs_do(spark):
    """Many copies, near copies of them, and pairs that somebody kept both."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(5)]
    near = [[*b[:50], *(f"n{i}{j}" for j in range(3)), *b[53:]] for i, b in enumerate(base)]
    far = [[*b[:34], *(f"f{i}{j}" for j in range(30))] for i, b in enumerate(base)]
    texts = [" ".join(rng.choice(base + near + near + far)) for _ in range(70)] + ["", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = neardup.exact_pairs(docs)
    auto = [(r.a, r.b) for r in pairs.filter("verdict = 'auto'").collect()]
    some = rng.sample(auto, 12)
    related = spark.createDataFrame([(b, a, "kept_both" if i < 8 else "superseded") for i, (a, b) in enumerate(some)], "from_document_id long, to_document_id long, resolution string")
    for known in (related.limit(0), related):
        expected, got = neardup.scan_links(pairs, docs, known), neardup.scan(docs, known)
        for x, y in zip(expected, got, strict=True):
            assert Counter(tuple(r) for r in x.select(y.columns).collect()) == Counter(tuple(r) for r in y.collect())
    _, members = neardup.class_pairs(docs)
    few = neardup.visiting_pairs(neardup.class_pairs(docs)[0], members, related.limit(0).select("from_document_id").withColumnRenamed("from_document_id", "id"))
    assert few.count() < 3 * 70 < len(auto)


def test_predecessor(spark):
    rows = [(1, 10, "2024-03-01", "2024-01-01"), (1, 11, "2024-03-01", "2024-02-01"), (1, 12, "2024-03-01", "2024-04-01"), (2, 13, "2024-01-01", "2024-01-01"), (2, 14, "2024-01-01", "2024-02-01")]
    df = spark.createDataFrame(rows, "new_id long, old_id long, new_clip_date string, old_clip_date string")
    assert sorted((r.new_id, r.old_id) for r in neardup.predecessor(df).collect()) == [(1, 11), (2, 13)]
