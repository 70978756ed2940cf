import hashlib
import math
import random

import numpy as np

from clipmill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"  # a column name that clashes with an output


def brute(rows, parts=8, k=16, rounds=6):
    """Plain nearest entries over all entries, in Python's own integers."""
    fine = lambda v: v is not None and v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label, _ in rows if fine(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    step = width // parts
    cells = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cells[:k]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[nearest(p, c[p])[1] for p in range(parts)] for c in cells]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, code in zip(cells, codes, strict=True) if code[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cells, strict=True):
        found = [nearest(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    return [(i, code, error, by_label[label], sha) for i, code, error, label in out]


def check(spark, rows):
    found = vector_codes.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows), key=key)


def test_random_vectors_with_bad_rows_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(16)], rng.choice([None, 1, 2]), "x") for i in range(300)]
    rows += [(i, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(16)], 3, "x") for i in range(290, 420)]  # ties, equal ids
    rows += [rows[0], rows[0], (None, [0.5] * 16, None, None), (1000, None, 1, "x"), (1001, [], 1, "x"), (1002, [0.1] * 15, 1, "x"), (1003, [0.1] * 24, 1, "x")]
    rows += [(1004, [0.1] * 15 + [None], 1, "x"), (1005, [0.1] * 15 + [float("nan")], 1, "x"), (1006, [float("-inf")] + [0.1] * 15, 1, "x")]
    check(spark, rows)


def test_equal_first_vectors_leave_entries_unused(spark):
    rng = random.Random(4)
    check(spark, [(i, [1.0] * 8, 1, "x") for i in range(40)] + [(i, [rng.random() * 9 - 4 for _ in range(8)], 2, "x") for i in range(40, 90)])


def test_fewer_vectors_than_entries(spark):
    check(spark, [(3, [0.1 * i for i in range(8)], 1, "x"), (2, [-0.2 * i for i in range(8)], 1, "x")])


def test_empty_table_and_no_kept_vector(spark):
    assert vector_codes.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.digest(spark.createDataFrame([(1, None, 1, "x"), (2, [float("inf")] * 8, 1, "x")], SCHEMA)).count() == 0


def test_search_looks_at_fewer_entries_and_finds_the_same():
    rng = np.random.default_rng(1)
    entries = rng.integers(-900, 900, (1, 16, 8))
    books, x = vector_codes.Codebooks(entries), rng.integers(-900, 900, (4000, 8))
    gaps = ((x[:, None] - entries[0][None]) ** 2).sum(2)
    for start in (np.zeros(4000, np.int64), gaps.argmin(1), rng.integers(0, 16, 4000)):
        codes, far = books.search(0, x, start)
        assert (codes == gaps.argmin(1)).all() and (far == gaps.min(1)).all()


def test_rounds_leave_no_folder_behind(spark):
    from clipmill.llm import common

    before = set(common._FOLDERS)
    check(spark, [(i, [math.sin(i + j) for j in range(8)], 1, "x") for i in range(60)])
    assert set(common._FOLDERS) == before
