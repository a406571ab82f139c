import pytest
from conftest import SMALL

import __spark_entry__ as contract
from compare import compare, connect

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SMALL, contract.queries()[name], ORACLES[name]) is None
