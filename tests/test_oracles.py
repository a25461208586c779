"""Every registered query with an oracle equals it; the others run."""

import pytest

from scholarspark.plans.catalog import ORACLES, QUERIES

from .conftest import DATA
from .oracle import assert_same, connect

SF = f"{DATA}/sf0.01"
@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    got = assert_same(QUERIES[name](spark, SF), con, ORACLES[name])
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
