import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from clipmill.llm import sharding

SCHEMA = "doc_id long, text string, shard string"  # a column name that clashes with an output


def found_of(spark, rows, **kw):
    found = sharding.digest(spark.createDataFrame(rows, SCHEMA).repartition(5), **kw).collect()
    assert len(found) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    shards = defaultdict(list)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return found, {s: sum(r.size for r in own) for s, own in shards.items()}


def balanced(rows, held, shards=8):
    total, largest = sum(held.values()), max(len((t or "").encode()) + 1 for _, t, _ in rows)
    slack = largest + total / shards / sharding.WHOLE
    assert all(abs(held.get(s, 0) - total / shards) <= slack for s in range(shards)), held


def against_sql(rows, found):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "x"]).astype({"doc_id": "Int64"}))
    said = con.execute(sharding.ORACLE).fetchall()
    assert Counter(said) == Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in found)


@pytest.mark.parametrize("rows_a_range", [3, 40, 1 << 20])
def test_hot_copies_nulls_and_ranges_of_any_size(spark, rows_a_range):
    rng = random.Random(5)
    texts = ["hot text " * 9] * 300 + ["copy"] * 40 + ["", None] * 5 + ["ä" * rng.randrange(1, 200) + str(i) for i in range(500)]
    rows = [(rng.choice([None, *range(400)]), t, "x") for t in texts]
    rng.shuffle(rows)
    found, held = found_of(spark, rows, rows_a_range=rows_a_range)
    balanced(rows, held)
    against_sql(rows, found)
    shards = defaultdict(set)
    for r in found:
        shards[(r.size, r.text_crc32)].add(r.shard)
    divided = [k for k, s in shards.items() if len(s) > 1]
    assert len(divided) <= 1  # the hot group alone; small groups stay whole


def test_one_id_and_text_in_all_rows(spark):
    rows = [(7, "same", "x")] * 801
    found, held = found_of(spark, rows, rows_a_range=50)
    assert max(held.values()) - min(held.values()) <= 2 * 5


def test_very_long_text_and_few_rows(spark):
    rows = [(1, "y" * 300_000, "x"), (2, "z", "x"), (2, "z", "x"), (None, None, None)]
    found, held = found_of(spark, rows)
    against_sql(rows, found)
    assert sum(held.values()) == 300_001 + 2 + 2 + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.digest(empty).count() == 0
    assert sharding.sharded(empty).count() == 0


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    rows = [(i, f"text {i % 7} " * (i % 11), "own") for i in range(300)]
    path = f"file://{tmp_path}/out"
    told = {r.shard: (r.rows, r.bytes) for r in sharding.write_shards(spark.createDataFrame(rows, SCHEMA), path, shards=4).collect()}
    back = spark.read.parquet(path)
    assert Counter((r.row.doc_id, r.row.text, r.row.shard) for r in back.collect()) == Counter(rows)
    assert {r[0]: (r[1], r[2]) for r in back.groupBy("shard").agg({"slot": "count", "size": "sum"}).selectExpr("shard", "`count(slot)`", "`sum(size)`").collect()} == told


def test_text_ids(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string")
    assert {r.doc_id for r in sharding.digest(rows, shards=2).collect()} == {"a", "b", None}
