"""Every query that has SQL gives the same rows as DuckDB; the others run."""

import pytest
from oracle import connect, rows

import __spark_entry__ as entry
from fathom.plans import all_queries

WITH_SQL = sorted(all_queries.SQL)
WITHOUT = sorted(set(all_queries.QUERIES) - set(all_queries.SQL))


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, duck, tiny, name):
    mine = all_queries.QUERIES[name](spark, tiny).toPandas()
    want = duck.execute(all_queries.SQL[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, tiny, name):
    assert all_queries.QUERIES[name](spark, tiny).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "kind", "start_line", "end_line", "heading", "score"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
