"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert verdict.split()[0] in ("ok", "ROWS", "EMPTY"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
