"""End to end: folders into a store, searches, synchronisation, enrichment."""

import json

import pytest
from pyspark.sql import functions as F

from clipmill import api, cli, schema, serve
from clipmill.operators import families, filters, merge, sync
from clipmill.plans import ingest
from clipmill.sources import config
from clipmill.sources.store import Store, delete, upsert, with_ids
from clipmill.streaming import ingest as streams

LONG = " ".join(f"word{i}" for i in range(120))


def write(folder, name, title, body):
    (folder / name).write_text(f"# source: {title}\n{body}")


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    inbox = tmp_path_factory.mktemp("inbox")
    write(inbox, "20240101_10-00-00.txt", "Notes - Brave", f"The cathedral of Sèvres. {LONG}")
    write(inbox, "20240102_10-00-00.txt", "Notes again - Brave", f"The cathedral of Sèvres. {LONG} more")
    write(inbox, "20240103_10-00-00.md", "Design", "# Memory\nA page about memory.\n## Tables\nAnd about tables, with a cathedral.")
    write(inbox, "20240104_10-00-00.txt", "Zoom call", "skipped")
    (inbox / "other.csv").write_text("x")
    c = api.Collection(spark, f"file://{tmp_path_factory.mktemp('store')}")
    c.queue = c.ingest(f"file://{inbox}").collect()
    c.inbox = inbox
    return c


def test_ingest(collection):
    docs = {r.source_title: r for r in collection.store.read("documents").collect()}
    assert set(docs) == {"Notes - Brave", "Notes again - Brave", "Design"}
    assert docs["Design"].title == "Memory" and docs["Design"].clip_date == "2024-01-03 10:00:00" and docs["Design"].doctype_name == "markdown"
    assert len(docs["Design"].document_minhash) == 128
    relations = collection.store.read("document_relations").collect()
    assert [(r.from_document_id, r.to_document_id, r.resolution) for r in relations] == [(docs["Notes again - Brave"].id, docs["Notes - Brave"].id, "superseded")]
    assert [(r.document_id, r.tag) for r in collection.store.read("document_tags").collect()] == [(docs["Notes - Brave"].id, "superseded")]
    assert collection.queue == [] and collection.store.read("entries").count() == 4
    collection.ingest(f"file://{collection.inbox}")
    assert collection.store.read("documents").count() == 3  # known paths are passed over


def test_search_hides_and_annotates(collection):
    shown = api.rows_json(collection.search("cathed"))
    assert {d["source_title"] for d in shown} == {"Notes again - Brave", "Design"}
    every = {d["source_title"]: d for d in api.rows_json(collection.search("cathed", include_all=True, sort="date"))}
    assert every["Notes - Brave"]["superseded"] and every["Notes - Brave"]["current_document_id"] and not every["Design"]["superseded"]
    assert "\x02cathedral\x03" in every["Design"]["chunks"][0]["snippet"]
    assert len(api.rows_json(collection.search("sevres cathedral"))) == 1
    assert api.rows_json(collection.search("...")) == [] and api.rows_json(collection.search("cathed", date_to="2024-01-03")) and api.rows_json(collection.search("cathed", author="x")) == []


def test_semantic_search_and_enrichment(collection):
    with pytest.raises(api.NotEmbedded):
        collection.similar("memory")
    assert serve.answer(collection, "/similar?q=memory")[0] == 409
    assert collection.embed() == 4 and collection.embed() == 0
    found = api.rows_json(collection.similar("A page about memory.", limit=3))
    assert found[0]["source_title"] == "Design"
    assert collection.derive() == 6 and collection.derive() == 0
    assert collection.extract() > 0 and collection.extract() == 0
    assert collection.diff() == 1 and collection.diff() == 0
    assert collection.embed() == collection.store.read("claims").count()
    assert api.rows_json(collection.similar_claims("memory", 2))
    status = collection.derive_status().first()
    assert (status.total_documents, status.detailed_ok, status.brief_ok) == (3, 3, 3)
    assert collection.extraction_status().first().missing == 0
    assert collection.repair().count() == 0 and collection.scan().count() == 0


def test_indexes_answer_as_scans_do(collection):
    """Stored indexes until the store changes; then scans, until they are brought up to date."""
    def ask():
        found = api.rows_json(collection.search("cathed", include_all=True))
        hits = [(d["document_id"], round(d["best_rank"], 12), [c["snippet"] for c in d["chunks"]]) for d in found]
        return hits, [d["document_id"] for d in api.rows_json(collection.similar("A page about memory.", limit=3, mode="index"))]

    before = ask()
    assert collection.vector_index() is None
    collection.index()
    assert collection.vector_index() is not None and collection.text_index().mark() == str(collection.store.version("chunks"))
    assert ask() == before
    collection.index()
    assert len(collection.text_index().state()[1]) == 1


def test_selections_of_enrichment(collection, capsys):
    """Only what a flag asks for is made anew; a bad brief leaves the detailed summary as it is."""
    def run(*argv):
        cli.main(["--store", collection.store.folder, *argv])
        return json.loads(capsys.readouterr().out)

    store = collection.store
    one = store.read("derived_content").filter("content_type = 'brief'").orderBy("document_id").first()
    detailed = store.read("derived_content").filter(f"content_type = 'detailed' AND document_id = {one.document_id}").select("content", "source_hash").first()
    store.upsert("derived_content", store.spark.createDataFrame([(one.id, one.document_id, "brief", "spoilt", "bad")], "id long, document_id long, content_type string, content string, quality string"))
    assert run("derive") == {"derive": 0} and run("derive", "--bad-detailed") == {"derive": 0} and run("derive", "--status")[0]["brief_bad"] == 1
    assert run("derive", "--bad-brief") == {"derive": 2} and run("derive", "--status")[0]["brief_bad"] == 0
    assert store.read("derived_content").filter(f"content_type = 'detailed' AND document_id = {one.document_id}").select("content", "source_hash").first() == detailed
    assert store.read("derived_content").filter(f"content_type = 'brief' AND document_id = {one.document_id}").first().content == one.content
    collection.mark_derived(one.document_id, "brief", "bad")
    assert [r.quality for r in collection.derived(one.document_id).collect()] == ["bad", "ok"] and serve.answer(collection, f"/derived/{one.document_id}?type=detailed")[1][0]["content"] == detailed.content
    collection.mark_derived(one.document_id, "brief", "ok")
    old, new = sorted(r.id for r in store.read("documents").filter("source_title LIKE 'Notes%'").collect())
    assert [(r["from_document_id"], bool(r["added"])) for r in run("relations", "diff", "--document", str(new), "--other", str(old))] == [(new, True)]
    claims = store.read("claims").count()
    assert run("extract") == {"extract": 0} and run("extract", "--force") == {"extract": claims} and run("extract", "--status")[0]["claims"] == claims
    collection.embed()
    tags = sorted(map(tuple, store.read("document_tags").collect()))
    assert run("relations", "repair", "--document", str(one.document_id)) == [] and sorted(map(tuple, store.read("document_tags").collect())) == tags


def test_http_and_command_line(collection, capsys):
    status, body = serve.answer(collection, "/search?q=cathed&include_hidden=1")
    assert status == 200 and len(body) == 3 and "\x02" not in json.dumps(body)
    first = body[0]["document_id"]
    assert serve.answer(collection, f"/get/{first}")[1]["entries"] and serve.answer(collection, f"/entries/{first}")[1]
    assert serve.answer(collection, "/stats")[1]["documents"] == 3 and serve.answer(collection, "/derive/status")[0] == 200
    assert serve.answer(collection, f"/claims/doc/{first}")[0] == 200 and serve.answer(collection, "/claims/similar?q=x")[0] == 200
    assert serve.answer(collection, "/get/x")[0] == 400 and serve.answer(collection, "/get/99")[0] == 404 and serve.answer(collection, "/nope")[0] == 404
    for argv in (["stats"], ["about", "cathedral", "--method", "exact"], ["browse", "--sort", "source"], ["dump", "design"], ["in", str(first)]):
        cli.main(["--store", collection.store.folder, *argv])
        assert json.loads(capsys.readouterr().out)


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    write(inbox, "20240101_10-00-00.txt", "One", "first text here")
    for expected in (1, 1):
        streams.run_clips(spark, f"file://{inbox}", store, ingest.ingest, f"file://{tmp_path}/ck")
        assert store.read("documents").count() == expected
    write(inbox, "20240102_10-00-00.txt", "Two", "quite another text")
    streams.run_clips(spark, f"file://{inbox}", store, ingest.ingest, f"file://{tmp_path}/ck")
    assert store.read("documents").count() == 2


def test_tidied(spark):
    rows = [("p", 0, "chat", "a", "x [noise]"), ("p", 1, "chat", "a", "y"), ("p", 2, "chat", "b", "[noise]"), ("p", 3, "chat", "a", "z"), ("q", 0, None, "a", "x [noise]")]
    df = spark.createDataFrame(rows, "path string, position int, doctype_name string, author string, body string")
    types = (config.DocType("chat", cleanup_patterns=(r"\[noise\]",), merge_consecutive_same_author=True),)
    assert sorted((r.path, r.position, r.body) for r in ingest.tidied(df, types).collect()) == [("p", 0, "x\ny\nz"), ("q", 0, "x [noise]")]


def test_positional_merge(spark):
    turn = lambda key, doc, i, body, author="a": (key, doc, i, author, body)
    body = "x" * 75
    stored = spark.createDataFrame([turn("k", 1, 0, "start"), turn("k", 1, 1, body), turn("k", 1, 2, body + "y"), turn("k", 2, 0, "other")], "merge_key string, document_id long, position int, author string, body string")
    new = [turn("k", 9, 0, "before"), turn("k", 9, 1, f" {body} "), turn("k", 9, 2, body + "y"), turn("k", 9, 3, "after", None), turn("k", 8, 0, body[:70])]
    df = spark.createDataFrame(new, "merge_key string, new_doc long, position int, author string, body string")
    assert [(r.new_doc, r.document_id, r.new_start, r.run_length, r.run_bytes) for r in merge.overlaps(stored, df).collect()] == [(9, 1, 1, 2, 153)]
    assert [(r.document_id, r.position, r.author, r.body) for r in merge.positional_merge(stored, df).collect()] == [(1, 3, None, "after")]
    assert merge.overlaps(stored, df, least=154).count() == 0


def test_families(spark):
    rel = spark.createDataFrame([(2, 1, "superseded"), (3, 1, "superseded"), (4, 3, "superseded"), (9, 8, "superseded"), (9, 4, "kept_both"), (2, 4, "kept_both")], "from_document_id long, to_document_id long, resolution string")
    docs = spark.createDataFrame([(1, "2024-01-09"), (2, "2024-01-02"), (3, "2024-01-02"), (4, "2024-01-01"), (8, "2024"), (9, "2024")], "id long, clip_date string")
    found = families.families(rel, docs)
    assert {(r.document_id, r.family, r.current_document_id) for r in found.collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (8, 8, 9), (9, 8, 9)}
    assert [(r.from_document_id, r.to_document_id) for r in families.conflicts(rel, found).collect()] == [(2, 4)]
    tags = spark.createDataFrame([(1, "superseded"), (7, "superseded"), (1, "junk")], "document_id long, tag string")
    assert {(r.document_id, r.tag) for r in families.repaired_tags(tags, found).collect()} == {(1, "junk"), (7, "superseded"), (2, "superseded"), (3, "superseded"), (4, "superseded"), (8, "superseded")}
    assert families.components(rel.limit(0).selectExpr("from_document_id a", "to_document_id b")).count() == 0


def test_sync(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    project = config.Project("p", "/x", (config.Rule("docs/*.md", "canonical", "guide"), config.Rule("*.md", "provisional")))
    disk = lambda rows: spark.createDataFrame([(p, t, t) for p, t in rows], "relative_path string, text string, content_hash string")
    counts = lambda df: {r.category: r.n for r in df.collect()}
    assert counts(ingest.sync_project(store, project, disk([("a.md", "# A\none"), ("docs/b.md", "two"), ("c.txt", "no rule"), ("x/y/z.md", "deep")]), "2024-01-01T00:00:00")) == {"new": 2}
    before = {r.relative_path: r.id for r in store.read("documents").collect()}
    assert counts(ingest.sync_project(store, project, disk([("a.md", "# A\nchanged"), ("d.md", "new")]), "2024-02-01T00:00:00")) == {"updated": 1, "missing": 1, "new": 1}
    docs = {r.relative_path: r for r in store.read("documents").collect()}
    assert docs["docs/b.md"].doc_status == "missing" and docs["a.md"].id == before["a.md"] and docs["a.md"].clip_date == "2024-01-01T00:00:00"
    bodies = {r.body for r in store.read("entries").collect()}
    assert bodies == {"changed", "two", "new"}
    assert counts(ingest.sync_project(store, project, disk([("a.md", "# A\nchanged"), ("d.md", "new"), ("docs/b.md", "two")]), "2024-03-01T00:00:00")) == {"unchanged": 3}
    assert {r.doc_status for r in store.read("documents").collect()} == {"canonical", "provisional"}
    assert sync.summary(sync.classify(disk([]).selectExpr("'p' project", "relative_path", "content_hash"), store.read("documents").selectExpr("id", "project", "relative_path", "content_hash"))).first().category == "missing"


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert not store.exists("claims") and store.read("claims").count() == 0
    store.migrate()
    store.add_tags(spark.createDataFrame([(1, " Junk "), (1, "junk")], "document_id long, tag string"))
    assert store.read("document_tags").count() == 1
    store.remove_tags(spark.createDataFrame([(1, "junk")], "document_id long, tag string"))
    assert store.read("document_tags").count() == 0
    bad = spark.createDataFrame([(1, 2, "maybe")], "from_document_id long, to_document_id long, resolution string")
    with pytest.raises(ValueError, match="domain"):
        store.write("document_relations", bad)
    link = lambda r: spark.createDataFrame([(1, 2, r)], "from_document_id long, to_document_id long, resolution string")
    store.upsert("document_relations", link("superseded"))
    store.upsert("document_relations", link("kept_both"))
    assert [r.resolution for r in store.read("document_relations").collect()] == ["kept_both"]
    store.append("documents", spark.createDataFrame([(1, [1, 2])], "id long, document_minhash array<bigint>"))
    store.append("entries", spark.createDataFrame([(5, 1, 0, "a b c d"), (6, 9, 0, "orphan")], "id long, document_id long, position int, body string"))
    store.migrate()
    assert len(store.read("documents").first().document_minhash) == 128 and [r.id for r in store.read("entries").collect()] == [5]
    store.vacuum("documents")
    assert store.read("documents").count() == 1
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")} and delete(old, new, ["k"]).count() == 1
    numbered = with_ids(spark.range(100).repartition(7).withColumnRenamed("id", "v"), 10, ["v"])
    assert all(r.id == r.v + 11 for r in numbered.collect())
    assert schema.violations(link("other"), "document_relations").count() == 1


def test_config(tmp_path):
    tags = config.Tags(includes={"project-x": ("a", "b"), "a": ("deep",)})
    assert tags.expand(["junk", "project-x", "a"]) == ["junk", "project-x", "a", "b", "deep"]
    assert tags.hidden() == ["junk", "archived", "superseded"] and tags.hidden(["x"]) == ["x"] and tags.hidden(include_all=True) == []
    (tmp_path / "tags.toml").write_text('[defaults]\nexclude = ["z"]\n[includes]\nm = ["n"]\n')
    assert config.Tags.load(str(tmp_path / "none"), str(tmp_path / "tags.toml")).hidden() == ["z"]
    (tmp_path / "t.toml").write_text('[[doctype]]\nname = "n"\nparser = "markdown"\nextract = false\nunknown = 1\n')
    assert config.no_extract(config.load_doctypes(str(tmp_path / "t.toml"))) == ["n"] and len(config.load_doctypes(None)) == 6
    with pytest.raises(config.ConfigError):
        config.DocType("n", parser="nope")
    (tmp_path / "m.toml").write_text('[[docs]]\nglob = "a/*.m?"\nstatus = "canonical"\n')
    (tmp_path / "r.toml").write_text(f'[[project]]\nname = "p"\nmanifest = "{tmp_path}/m.toml"\n')
    project = config.load_projects(str(tmp_path / "r.toml"))[0]
    assert project.root == str(tmp_path) and project.rules[0].pattern == r"^a/[^/]*\.m[^/]$"
    with pytest.raises(config.ConfigError):
        config.load_projects(str(tmp_path / "r.toml"), "q")
    (tmp_path / "m.toml").write_text('[[docs]]\nglob = "a"\nstatus = "odd"\n')
    with pytest.raises(config.ConfigError):
        config.load_manifest(str(tmp_path / "m.toml"))


def test_author_filters(spark):
    df = spark.createDataFrame([("Ann_Lee",), ("AnnXLee",), ("ÀB",), (None,)], "author string")
    assert [r[0] for r in df.filter(filters.author_like(F.col("author"), "nn_l")).collect()] == ["Ann_Lee", "AnnXLee"]
    assert [r[0] for r in df.filter(filters.author_contains(F.col("author"), "nn_l")).collect()] == ["Ann_Lee"]
    assert df.filter(filters.author_like(F.col("author"), "àb")).count() == 0 and df.filter(filters.author_contains(F.col("author"), "àb")).count() == 1


def thread_clips():
    """Overlapping captures of a chat, one with nothing new, with a message that is said twice; and another chat."""
    chat = [(["Ann", "Bob", "Cy"][i % 3], "ok" if i % 5 == 4 else f"message {i} " + "words " * 12, f"1:{i:02d} PM") for i in range(20)]
    write = lambda title, part: f"# source: {title}\n" + "\n".join(f"{a}  [{t}]\n{b}\n" for a, b, t in part)
    parts = [("alpha", 0, 12), ("alpha", 6, 12), ("alpha", 7, 20), ("beta", 0, 5)]
    return [(f"/in/2024010{j}_00-00-00.txt", write(f"{title} (Channel) - Slack", chat[a:b])) for j, (title, a, b) in enumerate(parts, 1)]


def test_one_batch_equals_one_file_at_a_time(spark, tmp_path):
    from dataclasses import replace

    from clipmill.sources.config import BUILT_IN
    from clipmill.sources.store import Store

    rows = thread_clips()
    types = tuple(replace(t, parser="chat") if t.name == "slack" else t for t in BUILT_IN)
    batch = lambda part: spark.createDataFrame(part, "path string, raw string")
    stores = [Store(spark, f"file://{tmp_path}/{n}") for n in "ab"]
    ingest.ingest(stores[0], batch(rows), types)
    for row in rows:
        ingest.ingest(stores[1], batch([row]), types)
    found = []
    for store in stores:
        names = store.read("documents").selectExpr("id AS document_id", "source_title AS doc_title", "clip_date AS doc_date")
        told = store.read("entries").join(names, "document_id")
        found.append(sorted((r.doc_title, r.position, r.author, r.body, r.file_path, r.doc_date) for r in told.collect()))
        assert sorted(r.doc_title[:5] for r in names.collect()) == ["alpha", "beta "]
    assert found[0] == found[1] and len(found[0]) == 25
    assert [p for t, p, *_ in found[0] if t.startswith("alpha")] == list(range(20))


def test_bad_files_are_passed_over_and_scripts_parse(spark, tmp_path, caplog):
    from clipmill.sources import clips
    from clipmill.sources.config import DocType, load_doctypes
    from clipmill.sources.store import Store

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "20240101_000000.txt").write_bytes(b"# source: Notes\n\xff\xfe broken")
    (tmp_path / "in" / "20240102_000000.txt").write_text("# source: Board log\nleft|hello there\nright|general answer")
    (tmp_path / "in" / "20240103_000000.txt").write_text("# source: Board log two\nno bar here")
    script = tmp_path / "bars.py"
    script.write_text("import json, sys\nrows = [x.rstrip().split('|', 1) for x in open(sys.argv[1])]\nprint(json.dumps({'entries': [{'author': a, 'body': b} for a, b in rows] + [{'body': ' '}]}))\n")
    config = tmp_path / "types.toml"
    config.write_text(f'[[doctype]]\nname = "board"\nsource_pattern = "Board"\npreprocessor = "{script}"\n')
    types = load_doctypes(str(config))
    assert types == (DocType("board", "Board", preprocessor=str(script)),)
    store = Store(spark, f"file://{tmp_path}/store")
    with caplog.at_level("WARNING"):
        ingest.ingest(store, clips.read_clips(spark, f"file://{tmp_path}/in"), types)
    assert sorted((r.author, r.body) for r in store.read("entries").collect()) == [("left", "hello there"), ("right", "general answer")]
    assert "20240101_000000.txt: not UTF-8" in caplog.text and "20240103_000000.txt" in caplog.text


def test_appends_write_new_rows_alone(spark, tmp_path, monkeypatch):
    from clipmill.sources import store as stores

    monkeypatch.setattr(stores, "MOST_FOLDERS", 4)
    store = stores.Store(spark, f"file://{tmp_path}/s")
    rows = lambda n: spark.createDataFrame([(n, f"t{n}")], "document_id long, tag string")
    sizes = []
    for n in range(5):
        store.append("document_tags", rows(n))
        sizes.append(len(store.state("document_tags")[2]))
    assert sizes == [1, 2, 3, 1, 2] and sorted(r.document_id for r in store.read("document_tags").collect()) == [0, 1, 2, 3, 4]
    store.vacuum("document_tags")
    assert store.read("document_tags").count() == 5
