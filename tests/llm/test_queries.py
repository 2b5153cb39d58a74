"""The operators' queries that SQL can express, against DuckDB."""

import pytest

from caseloom.llm import queries
from tests.test_queries import connect, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    want = connect(sf).sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
