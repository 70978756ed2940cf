import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmill.operators import vector
from clipmill.operators.vector_index import ODD, VectorIndex

from .conftest import DATA


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)


def exact(rows, query, k, allowed=None):
    def cosine(v):
        if v is None:
            return 0.0
        x, y = np.array([0.0 if a is None else a for a in v[: len(query)]], float), np.array(query[: len(v)], float)
        norms = np.linalg.norm(x) * np.linalg.norm(y)
        return float(x @ y / norms) if norms > 0 else 0.0

    return sorted(((-round(cosine(v), 6), i) for i, v in rows if allowed is None or i in allowed))[:k]


def same(found, expected):
    got = sorted((-round(r.similarity, 6), r.id) for r in found)
    return [i for _, i in got] == [i for _, i in expected] and np.allclose([s for s, _ in got], [s for s, _ in expected], atol=2e-6)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    found = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(900)]
    found += [(900 + i, found[5][1]) for i in range(300)]  # a quarter are copies of one vector
    return found + [(1300, None), (1301, []), (1302, [0.0] * 16), (1303, [1.0] * 4), (1304, [None] * 16)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return VectorIndex.build(frame(spark, rows), f"file://{tmp_path_factory.mktemp('index')}/i", lists=20)


def test_all_lists_give_the_exact_result(index, rows):
    for query in (rows[7][1], rows[5][1], [0.5] * 16, [-1.0] * 16):
        assert same(index.search(query, 12, probes=20).collect(), exact(rows, query, 12))
    assert index.sizes[ODD] == 5


def test_recall_of_the_chosen_probes(index, rows):
    asked = [(i, v) for i, v in rows[:900] if i % 30 == 0]
    found = {}
    for r in index.search_many(asked, 10).collect():
        found.setdefault(r["query"], set()).add(round(r.similarity, 6))
    held = [len({-s for s, _ in exact(rows, v, 10)} & found[i]) / len({-s for s, _ in exact(rows, v, 10)}) for i, v in asked]
    assert np.mean(held) >= 0.95 and index.probes < 20


def test_only_allowed_ids(spark, index, rows):
    allowed = {i for i, _ in rows if i % 7 == 1}
    found = index.search(rows[5][1], 9, probes=20, allowed=spark.createDataFrame([(i,) for i in allowed], "id long")).collect()
    assert same(found, exact(rows, rows[5][1], 9, allowed))


def test_added_vectors_are_found(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    index = VectorIndex.build(frame(spark, rows[:150]), f"file://{tmp_path}/i", lists=9)
    index.add(frame(spark, [*rows[150:], (999, [0.0] * 8)]))
    for i in (3, 170):
        assert same(index.search(rows[i][1], 5, probes=9).collect(), exact(rows, rows[i][1], 5))


def test_empty_table(spark, tmp_path):
    index = VectorIndex.build(frame(spark, []), f"file://{tmp_path}/i")
    assert index.search([1.0, 2.0], 3).collect() == []


def test_few_files_are_opened(spark, tmp_path):
    """On unclustered vectors: recall of 0.95, and under a tenth of the files."""
    vectors = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    index = VectorIndex.build(vectors, f"file://{tmp_path}/i")
    files = len(list((tmp_path / "i").rglob("*.parquet")))
    codes = len(list((tmp_path / "i" / "codes").glob("*.parquet")))
    asked = [(r.id, r.embedding) for r in vectors.filter("id % 100 = 0").collect()]
    held, opened = [], []
    batch = {}
    for r in index.search_many(asked, 10).collect():
        batch.setdefault(r["query"], set()).add(r.id)
    for i, v in asked:
        held.append(len(batch[i] & {r.id for r in vector.knn(vectors, v, 10).collect()}) / 10)
    for _, v in asked[:5]:
        lists = [r.list for r in index.finalists([v], 10, index.probes, None).select("list").distinct().collect()]
        opened.append((codes + 1 + index.vectors(lists).select(F.input_file_name()).distinct().count()) / files)
    assert np.mean(held) >= 0.95
    assert max(opened) < 0.1, opened
