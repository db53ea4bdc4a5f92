"""Every registered query against its SQL, on the smallest tables."""

import os

import __spark_entry__ as entry
import pytest
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
# Results that are empty on the smallest tables: no page fails, or no series ends where it has to.
MAY_BE_EMPTY = {"api_page_errors", "horizon_error"}


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    query = entry.queries()[name]
    if name not in SQL:
        assert query(spark, SF_DIR).count() > 0
        return
    difference = compare(spark, SF_DIR, query, SQL[name], database)
    assert difference == "" or (name in MAY_BE_EMPTY and difference.startswith("no rows"))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())
