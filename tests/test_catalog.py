"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
import check
import oracles
from nudgeline import catalog

EXPECTED = oracles.oracle_sql()

@pytest.fixture(scope="module")
def connection(small):
    return check.duck(small)


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(EXPECTED)
    assert set(catalog.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, connection, small, name):
    problem, n = check.compare(
        spark, connection, small, name, catalog.queries()[name], EXPECTED.get(name)
    )
    assert problem == "" and n > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
