"""Every core query against its SQL on the smallest tables."""

import pytest

from cinelake import catalog
from tests.compare import DATA, assert_equal, database


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    assert_equal(catalog.QUERIES[name](spark, DATA), db, catalog.SQL[name])


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
