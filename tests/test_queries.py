"""Every registered query next to its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if n not in entry.EXTRA}
TWINS = {n: t for n, t in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name, QUERIES[name], TWINS.get(name)) is None


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
