"""Every registered query against its SQL twin, on the smallest given tables."""

import pytest
from conftest import SF
from oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from queries import QUERIES

ROWS_ONLY = {"source_fingerprint"}


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(oracle_sql()) == ROWS_ONLY
    assert entry(spark).limit(1).count() == 1
