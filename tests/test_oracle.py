"""Every registered graph query against its DuckDB SQL on the smallest tables."""

import oracle
import pytest

from codeloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_equal(spark, con, name):
    assert oracle.compare(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
