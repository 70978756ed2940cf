import duckdb

import __spark_entry__ as e


def test_turns_without_text_match_sql(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", "a b")], "conv_id long, turn int, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet/*.parquet'")
    expected = con.sql(f"SELECT conv_id, turn, n, claim FROM ({e.oracle_sql()['claim_lines']}) ORDER BY ALL").fetchall()
    got = e.queries()["claim_lines"](spark, f"file://{sf}").select("conv_id", "turn", "n", "claim")
    assert sorted(map(tuple, got.collect())) == expected
