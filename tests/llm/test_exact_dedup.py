import hashlib
import random

from clipmill.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, kept string"  # a column name that clashes with an output


def brute(rows):
    groups = {}
    for i, (doc_id, text, _) in enumerate(rows):
        groups.setdefault(text or "", []).append((doc_id if doc_id is not None else -(10**9), i))
    out = []
    for i, (doc_id, text, _) in enumerate(rows):
        members = groups[text or ""]
        top = max(m[0] for m in members)
        out.append((doc_id, None if top == -(10**9) else top, len(members), hashlib.sha256((text or "").encode()).hexdigest()))
    return out, groups


def check(spark, rows, frequent):
    found = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), frequent=frequent).collect()
    expected, groups = brute(rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=key) == sorted(expected, key=key)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups)  # exactly one of each group, ties and null ids included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_random_rows_with_hot_groups(spark):
    rng = random.Random(3)
    texts = ["hot"] * 60 + ["warm"] * 20 + ["", None] + [f"t{i}" for i in range(20)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), "x") for _ in range(300)]
    check(spark, rows, frequent=2)
    check(spark, rows, frequent=1024)


def test_empty_table_and_one_row(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(5, None, "x")], 4)


def test_white_space_and_case_count(spark):
    check(spark, [(1, "a", "x"), (2, "a ", "x"), (3, "A", "x"), (4, "a", "x"), (4, "a", "x"), (9, "x" * 200_000, "x")], 4)
