"""Corpus queries that have SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tabveil.llm import queries
from tests.test_oracle import con, rows  # noqa: F401


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_as_sql(spark, con, sf_dir, name):  # noqa: F811
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
