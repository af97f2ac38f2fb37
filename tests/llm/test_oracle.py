"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import oracle
import pytest
from codeloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equal(spark, name):
    assert oracle.compare(spark, oracle.duck(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == ""
