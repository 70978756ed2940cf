import random

import pytest

from clipmill.operators.neighbours import neighbours


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_next_and_previous_of_groups_in_several_ranges(spark, partitions):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), f"d{rng.randrange(9)}", rng.choice([None, "x"])) for i in range(300)] + [(900, "alone", "d1", "x")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: (r.next_id, r.previous_id) for r in neighbours(spark.createDataFrame(rows, "id long, k string, d string, l string").repartition(5), ["k", "l"], ["d"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for i, k, d, lang in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault((k, lang), []).append(i)
    expected = {i: (g[n + 1] if n + 1 < len(g) else None, g[n - 1] if n else None) for g in groups.values() for n, i in enumerate(g)}
    assert found == expected


def test_no_rows(spark):
    assert neighbours(spark.createDataFrame([], "id long, k string"), ["k"], []).count() == 0
