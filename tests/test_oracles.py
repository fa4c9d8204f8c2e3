"""Every query that has SQL beside it gives the SQL's rows on the smallest tables (the llm queries have their own tests)."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def rows(pdf, columns):
    plain = lambda v: "" if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in pdf[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ours = entry.queries()[name](spark, DIR).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
