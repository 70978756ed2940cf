"""Buckets, crashes, two writers, and families after a few links."""

import random

import pytest

from clipmill.operators import families
from clipmill.plans import ingest
from clipmill.sources import store as stores
from clipmill.sources.store import Store
from clipmill.sources.versions import Conflict, Versions


def tags(spark, rows):
    return spark.createDataFrame(rows, "document_id long, tag string")


def all_of(store, table):
    return sorted(tuple(r) for r in store.read(table).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def files(store, table):
    return {f"{p['folder']}/{b}" for p in store.state(table)[2] for b in p["live"]}


def test_changes_cost_the_buckets_they_touch(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "ROWS_A_BUCKET", 10)
    vectors = lambda ids, x: spark.createDataFrame([(i, [x]) for i in ids], "id long, embedding array<float>")
    store.write("vec_chunks", vectors(range(1000), 0.0))
    assert store.state("vec_chunks")[1] == 100
    before = files(store, "vec_chunks")
    store.upsert("vec_chunks", vectors([*range(5), *range(1000, 1005)], 1.0))
    assert len(before - files(store, "vec_chunks")) <= 10 and len(files(store, "vec_chunks") - before) <= 10
    assert all_of(store, "vec_chunks") == [(i, [1.0 if i < 5 or i >= 1000 else 0.0]) for i in range(1005)]
    before = files(store, "vec_chunks")
    store.delete("vec_chunks", vectors([7, 8, 5000], 0.0))
    assert len(before ^ files(store, "vec_chunks")) <= 4 and store.read("vec_chunks").count() == 1003
    store.append("vec_chunks", vectors(range(2000, 2100), 2.0))
    store.update("vec_chunks", vectors([2001], 3.0))
    assert sorted(tuple(r) for r in store.pick("vec_chunks", spark.createDataFrame([(2001,), (4,), (7,)], "id int")).collect()) == [(4, [1.0]), (2001, [3.0])]
    store.compact("vec_chunks")
    assert len(store.state("vec_chunks")[2]) == 1 and store.state("vec_chunks")[1] == 111 and store.read("vec_chunks").count() == 1103
    store.vacuum("vec_chunks")
    assert store.read("vec_chunks").count() == 1103


def test_a_crash_leaves_the_version_before(spark, store, monkeypatch):
    store.write("document_tags", tags(spark, [(1, "a")]))

    def crash(*_):
        raise KeyboardInterrupt

    for step in ("commit", "_settle"):
        with monkeypatch.context() as m:
            m.setattr(Versions, step, crash)
            for change in (lambda: store.write("document_tags", tags(spark, [(2, "b")])), lambda: store.append("document_tags", tags(spark, [(2, "b")])), lambda: store.upsert("document_tags", tags(spark, [(1, "a")]))):
                with pytest.raises(KeyboardInterrupt):
                    change()
        assert all_of(store, "document_tags") == [(1, "a")]
    store.append("document_tags", tags(spark, [(3, "c")]))
    assert all_of(store, "document_tags") == [(1, "a"), (3, "c")]


def test_two_writers_lose_nothing(spark, store, monkeypatch):
    other = Store(spark, store.folder)
    store.write("document_tags", tags(spark, [(1, "a")]))
    for n, change in enumerate((lambda: store.append("document_tags", tags(spark, [(2, "b")])), lambda: store.upsert("document_tags", tags(spark, [(3, "c")])), lambda: store.delete("document_tags", tags(spark, [(1, "a")])))):
        put, once = Store._put, []

        def slow(self, *args, put=put, once=once, n=n):
            part = put(self, *args)
            if not once:
                once.append(1)
                other.append("document_tags", tags(spark, [(100 + n, "x")]))  # between its reading and its commit
            return part

        with monkeypatch.context() as m:
            m.setattr(Store, "_put", slow)
            change()
    assert all_of(store, "document_tags") == [(2, "b"), (3, "c"), (100, "x"), (101, "x"), (102, "x")]
    version = store.version("document_tags")
    other.append("document_tags", tags(spark, [(9, "y")]))
    with pytest.raises(Conflict):
        store.write("document_tags", tags(spark, []), after=version)


def test_a_store_of_earlier_versions_is_read(spark, store, tmp_path):
    tags(spark, [(1, "a"), (2, "b")]).write.parquet(f"{store.folder}/document_tags/v-old")
    (tmp_path / "s" / "document_tags" / "current").write_text("v-old")
    assert all_of(store, "document_tags") == [(1, "a"), (2, "b")]
    store.upsert("document_tags", tags(spark, [(3, "c")]))
    store.remove_tags(tags(spark, [(1, "a")]))
    assert all_of(store, "document_tags") == [(2, "b"), (3, "c")]


def test_families_follow_a_few_links(spark, store, monkeypatch):
    """Batch after batch the same as all anew, and tags of other families stay in their files."""
    monkeypatch.setattr(stores, "ROWS_A_BUCKET", 20)
    rng = random.Random(6)
    docs = [(i, f"2024-01-{1 + (i * 7) % 28:02d}") for i in range(80)]
    store.write("documents", spark.createDataFrame(docs, "id long, clip_date string"))
    links = [(i, i - 1) for i in range(1, 60) if i % 4] + [(70, 60)]
    relation = lambda rows: spark.createDataFrame([(a, b, "superseded") for a, b in rows], "from_document_id long, to_document_id long, resolution string")
    store.write("document_tags", tags(spark, [(3, "own"), (79, "superseded")]))
    store.upsert("document_relations", relation(links))
    ingest.recompute(store)
    for batch in ([(4, 3), (75, 74), (3, 2)], [(77, 76), (76, 8), *((i, 0) for i in rng.sample(range(61, 74), 5))]):
        wrote, upsert = [], Store.upsert

        def told(self, table, new, wrote=wrote, upsert=upsert):
            wrote.append((table, new.count()))
            upsert(self, table, new)

        store.upsert("document_relations", relation(batch))
        monkeypatch.setattr(Store, "upsert", told)
        ingest.relate(store, spark.createDataFrame(batch, "a long, b long"))
        found = families.families(store.read("document_relations"), store.read("documents"))
        assert all_of(store, "document_families") == sorted((r.document_id, r.family) for r in found.collect())
        assert all_of(store, "document_tags") == sorted(tuple(r) for r in families.repaired_tags(store.read("document_tags"), found).collect())
        monkeypatch.setattr(Store, "upsert", upsert)
        assert [t for t, _ in wrote] == ["document_families"] and 0 < wrote[0][1] < store.read("document_families").count() / 2
    store.update("documents", spark.createDataFrame([(5, "2025-01-01")], "id long, clip_date string"))
    ingest.relate(store, spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(5,)], "id long"))
    found = families.families(store.read("document_relations"), store.read("documents"))
    assert all_of(store, "document_tags") == sorted(tuple(r) for r in families.repaired_tags(store.read("document_tags"), found).collect())
    assert (5, "superseded") not in all_of(store, "document_tags") and (3, "own") in all_of(store, "document_tags")
