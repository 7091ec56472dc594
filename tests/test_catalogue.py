"""Every registered query against its SQL, on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as registry
from catalogue import checking

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    with checking.connect(FOLDER) as c:
        yield c


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, connection, name):
    assert checking.differences(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) is None


def test_entry(spark):
    assert registry.entry(spark).count() == 6
