"""Every query of the entry module against its SQL, run by DuckDB on the same files."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as e

from .conftest import DATA

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(n for n in e.queries() if not n.startswith("op") and n != "pipeline")
WITH_SQL = sorted(set(e.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, duck, name):
    df = e.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.sql(e.oracle_sql()[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert found == Counter(repr(tuple(plain(r[i]) for i in places)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(WITH_SQL)))
def test_others_run(spark, name):
    assert e.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_known_figures(spark):
    """Exact verdicts without the title route on the larger sample."""
    if os.path.exists(f"{DATA}/sf0.01"):
        verdicts = Counter(r.verdict for r in e.queries()["exact_jaccard_pairs"](spark, f"{DATA}/sf0.01").collect())
        assert verdicts == {"auto": 180, "prompt": 10}
