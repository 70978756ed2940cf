import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from clipmill.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(values, pairs):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near_pairs(values):
    values = sorted(values)
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= 3]


def cluster(rng, n, flips):
    base = rng.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = rng.choice(sorted(out))
        for _ in range(rng.randint(1, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


def test_fingerprints(spark):
    texts = ["", None, "One", "one TWO", "a b c", "a\x0bb\x1cc d", "É é É é", "x " * 5000, "the same the same the same", "\x85 \xa0"]
    rng = random.Random(2)
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_index_finds_all_links():
    rng = random.Random(5)
    values = np.array(sorted(set().union(*(cluster(rng, 40, 4) for _ in range(12)), {rng.getrandbits(64) for _ in range(300)})), np.uint64)
    order = values[np.argsort(simhash.gray_rank(values))]
    found = {(int(order[a]), int(order[b])) for q, m in simhash.GrayIndex(order).search(order, most=500) for a, b in zip(q, m) if order[a] < order[b]}
    assert found == set(near_pairs([int(v) for v in values]))


def test_gray_neighbours_differ_in_one_bit():
    ranks = np.arange(64, dtype=np.uint64)
    codes = ranks ^ (ranks >> np.uint64(1))
    assert (simhash.gray_rank(codes) == ranks).all()


def test_distributed_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPAN", 20)  # so that runs of one block are cut into ranges
    rng = random.Random(7)
    values = sorted(set().union(cluster(rng, 300, 2), *(cluster(rng, 15, 3) for _ in range(8)), {rng.getrandbits(64) for _ in range(200)}))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.candidate_links(df)).collect()}
    expected = roots(signed, [(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in near_pairs(values)])
    assert {v: got.get(v, v) for v in signed} == expected


def test_rows_ties_nulls_and_names(spark):
    rows = [(3, "a b c d", 1), (1, "A b c d", 1), (2, None, 1), (7, "", 1), (None, "a b c d", 1), (1, "A b c d", 1), (9, "something else entirely here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert found == {(3, 1), (1, 1), (2, 2), (7, 2), (None, 1), (9, 9)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
    only = simhash.near_duplicates(df.filter(F.col("doc_id").isNull())).collect()
    assert [(r.doc_id, r.component_id) for r in only] == [(None, None)]


def test_a_hot_block_of_many_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPAN", 1500)
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 64, 20_000, np.uint64, endpoint=False)
    values[:7000] = (values[:7000] >> np.uint64(16)) | np.uint64(0xABCD << 48)  # a third shares its first block
    source = rng.integers(0, 14_000, 3000)
    for _ in range(3):  # the last are copies with up to three bits turned
        turned = np.uint64(1) << rng.integers(0, 64, 3000, np.uint64)
        values[17_000:] = (values[source] if _ == 0 else values[17_000:]) ^ turned
    values = np.unique(values)
    pairs = []
    for at in range(0, len(values), 500):
        near = np.bitwise_count(values[at : at + 500, None] ^ values[None]) <= 3
        pairs += [(int(a) + at, int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a + at < b]
    signed = [int(v) for v in values.view(np.int64)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4)
    links = {(r.a, r.b) for r in simhash.candidate_links(df).collect()}
    truth = roots(range(len(values)), pairs)
    place = {v: i for i, v in enumerate(signed)}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in links)
    assert roots(range(len(values)), [(place[a], place[b]) for a, b in links]) == truth and len(pairs) > 1000
    assert len(links) < 4 * len(values)


def test_every_link_comes_from_the_index(monkeypatch):
    calls = []
    walk = simhash.GrayIndex.search
    monkeypatch.setattr(simhash.GrayIndex, "search", lambda self, *a, **k: calls.append(len(self.values)) or walk(self, *a, **k))
    for n in (1, 2, 5, 300):
        words = np.arange(n, dtype=np.uint64)[:, None]
        found = [np.concatenate(x) for x in zip(*simhash.range_links(words[:, 0], words, np.zeros(n, bool), None, 3, (3,)), strict=True)]
        assert len(found[0] if found else []) == n - 1 and calls and calls[-1] == n  # no size goes another way


def test_large_group_leaves_a_forest():
    rng = np.random.default_rng(3)
    words = np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 48, 4000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 48, 4000, np.uint64))
    words = np.unique(words)[:, None]
    links = list(simhash.range_links(words[:, 0], words, np.zeros(len(words), bool), None, 3, (3,)))
    assert sum(len(a) for a, _ in links) == len(words) - 1
