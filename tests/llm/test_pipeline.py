import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipmill.llm import queries
from clipmill.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.01"
    docs = [table(spark, sf, "documents")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs[-1], sf).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    kept = stages[1].join(labels, "doc_id").groupBy("quality").count().collect()
    counts = {r.quality: r["count"] for r in kept}
    assert counts[1] >= 0.97 * labels.filter("quality = 1").count() and counts.get(0, 0) <= 0.05 * labels.filter("quality = 0").count()


def test_lines_keep_rows_and_only_delete(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert before.keys() == after.keys()
    for doc_id, (text, n) in after.items():
        rest = iter(before[doc_id].split("\n"))
        assert n == len(text) and (not text or all(line in rest for line in text.split("\n")))


def test_one_document_of_each_group_stays(stages):
    """Against all pairs of five-word sets; every document goes that brute force drops, and no other."""
    from tests.llm.test_similar import brute

    kept, pairs = brute([(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()])
    assert {r.doc_id for r in stages[3].collect()} == kept and stages[3].count() == len(kept)


def test_mix_and_pieces(stages):
    assert {r.doc_id for r in stages[4].collect()} <= {r.doc_id for r in stages[3].collect()}
    assert stages[5].count() == stages[4].count() and stages[5].filter("NOT lossless").count() == 0
    assert stages[5].filter(F.size("ids") == 0).select("doc_id").distinct().count() <= 1  # the one empty text, however often it is repeated


def test_run_and_bad_rows(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "and", "lake", "moves", "slowly", "north"]) for _ in range(rng.randint(0, 30)))
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(30)] + [(None, None, None, None, None), (4, "", "en", None, 0), (5, "x" * 50_000, "en", "s1", 0), (5, "x" * 50_000, "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/a").columns == ["doc_id", "source", "ids", "n_pieces", "decoded_sha256", "lossless"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"file://{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0


def test_every_query_runs(spark):
    sf = "/root/testdata/sf0.001"
    pages = table(spark, sf, "pages").count()
    docs = table(spark, sf, "documents").count()
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() == (pages if name in ("op1_url_filter", "op6_warc") else docs), name
