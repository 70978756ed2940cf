"""The near-duplicate stage: five-word sets with a Jaccard similarity of 0.8, proposed by the index."""

import random
import re

from clipmill.llm import simhash
from clipmill.llm.common import KEY, key_of, stored, table
from clipmill.operators import neardup


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(kept ids, similar pairs of different sets) over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent, pairs = {i: i for i, _ in sets}, []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
                pairs += [(i, j)] if a != b else []
    return {i for i in parent if find(i) == i}, pairs


def fixture(rng, bases=12):
    """Edited copies with similarities on both sides of 0.8, a line that many share, short and empty texts."""
    word = lambda: rng.choice("lake north moves slowly stone river cold deep".split()) + str(rng.randint(0, 60))
    boiler = " ".join(word() for _ in range(12))
    texts = ["", None, "  ", "one two", "One  two", "a b c d e", "a b c d f"]
    for _ in range(bases):
        base = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (f" {boiler}" if rng.random() < 0.5 else ""))
            if rng.random() < 0.4:
                base = copy  # chains: their ends are less alike than 0.8
    rng.shuffle(texts)
    return list(enumerate(texts))


def held_against_brute_force(spark, rows):
    """No row goes that brute force keeps, and at least 95% of those go that it drops."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected, pairs = brute(rows)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert expected <= kept and len(pairs) > 20
    assert len(kept - expected) <= 0.05 * (len(rows) - len(expected))


def test_recall_on_copies_near_the_bound(spark):
    held_against_brute_force(spark, fixture(random.Random(3), 40))


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPAN", 16)
    held_against_brute_force(spark, fixture(random.Random(8)))


def test_group_of_edited_copies(spark):
    """300 texts that each differ from one another in a word or two are one group; 60 of another base aren't in it."""
    rng = random.Random(5)
    rows = []
    for n in (300, 60):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(220)]
        for k in range(n):
            copy = list(base)
            copy[rng.randrange(220)] = f"edit{k}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 300]


def test_sample_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == brute(rows)[0]


def test_rows_ties_nulls_and_names(spark):
    text = "a b c d e f g"
    rows = [(3, text, 1), (1, text.upper(), 1), (2, None, 1), (7, "", 1), (None, text, 1), (1, text.upper(), 1), (9, "something else entirely here", 1), (11, "word " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root long")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9, 11]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_verified_sends_a_set_once_to_a_tile(spark, monkeypatch):
    """All 780 pairs of 40 texts that are alike are one tile, to which 40 sets go, not 1,560."""
    seen, whole = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df: seen.append(((made := whole(df)).columns, made.count())) or made)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join([*words[: 60 - i], *[f"x{i}y{k}" for k in range(i)]])) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marked = stored(docs.select(*key_of("doc_id", "text"), simhash.classes_of("text").alias("p")).select(*KEY, "p.c")).select("c", *KEY)
    of = {r.c: r.id for r in marked.collect()}
    pairs = [(a, b) for a in of for b in of if a < b]
    got = simhash.verified(stored(spark.createDataFrame(pairs, "a long, b long")), marked, docs, "doc_id", "text")
    sets = {c: shingles(texts[i][1]) for c, i in of.items()}
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert [n for columns, n in seen if columns == ["tile", "id"]] == [40]
