import json

from clipmill.sources import config
from clipmill.sources.store import Store
from clipmill.streaming import sync

PROJECT = config.Project("p", "/x", (config.Rule("*.md", "canonical"),))


def state(store):
    docs = {r.relative_path: (r.id, r.doc_status) for r in store.read("documents").collect()}
    return docs, sorted(r.body for r in store.read("entries").collect())


def test_changes_and_tombstones_and_repeats(spark, tmp_path):
    folder, store = tmp_path / "changes", Store(spark, f"file://{tmp_path}/s")
    folder.mkdir()

    def tell(name, *changes):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("relative_path", "text", "deleted", "seq"), c, strict=True))) for c in changes))
        sync.run_changes(spark, f"file://{folder}", store, PROJECT, lambda: "2024-01-01T00:00:00", f"file://{tmp_path}/ck")
        return state(store)

    docs, bodies = tell("1.json", ("a.md", "early", False, 1), ("a.md", "one", False, 2), ("b.md", "two", None, 3), ("c.txt", "no rule", False, 4), ("d.md", "short-lived", False, 5), ("d.md", None, True, 6), (None, "x", False, 7))
    assert set(docs) == {"a.md", "b.md"} and bodies == ["one", "two"]
    later, bodies = tell("2.json", ("b.md", None, True, 8), ("a.md", "changed", False, 9))
    assert later == {"a.md": docs["a.md"], "b.md": (docs["b.md"][0], "missing")} and bodies == ["changed", "two"]
    versions = {t: store.version(t) for t in ("documents", "entries", "chunks")}
    again = spark.createDataFrame([("a.md", "a repeat that must not count", False, 10)], sync.CHANGE)
    sync.into_project(store, PROJECT, lambda: "2024-01-02T00:00:00")(again, 1)  # a batch number that is in already
    assert {t: store.version(t) for t in versions} == versions and state(store) == (later, bodies)
    back, bodies = tell("3.json", ("b.md", "two", False, 11))
    assert back["b.md"] == docs["b.md"] and bodies == ["changed", "two"]


def test_a_crash_before_the_children_is_made_good(spark, tmp_path, monkeypatch):
    from clipmill.plans import ingest

    store = Store(spark, f"file://{tmp_path}/s")
    handle = sync.into_project(store, PROJECT, lambda: "2024-01-01T00:00:00")
    batch = spark.createDataFrame([("a.md", "one", False, 1)], sync.CHANGE)
    with monkeypatch.context() as m:
        m.setattr(ingest, "add_children", lambda *_: 1 / 0)
        try:
            handle(batch, 0)
        except ZeroDivisionError:
            pass
    assert state(store)[1] == []
    handle(batch, 0)
    assert state(store)[1] == ["one"] and store.read("documents").count() == 1
