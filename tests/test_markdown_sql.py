"""``markdown_sections`` and its SQL on texts that look like Markdown, and on missing ones."""

import duckdb

import __spark_entry__ as e

TEXTS = ["# one\nx\n## two\n\ny", "a\n~~~\nopen", "```\n# x\n```", "\n\n  \nx\n", "a\r\nb\r", "", "  ", None, ">q<\n><\n>", "\u00a0\nx\x0b\n\u2028", "<\n\n~~~\n# no heading\n~~~", "plain\ntext\n"]


def test_texts_are_opaque_as_in_sql(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "x", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in e.queries()["markdown_sections"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(found, key=repr) == sorted(con.sql(e.oracle_sql()["markdown_sections"]).fetchall(), key=repr)
