"""Queries of this subpackage against their SQL on the smallest tables."""

import pytest

from cinelake.llm.queries import QUERIES
from cinelake.llm.sql import SQL
from tests.compare import DATA, assert_equal, database


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert_equal(QUERIES[name](spark, DATA), db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
