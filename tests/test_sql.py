"""Every query of the core against its SQL, over whole tables."""

import pytest
from conftest import rows, same_as_sql

from strataquery import catalog

#: Queries that find nothing in the smallest tables.
EMPTY = ("extension_methods", "xml_search")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert catalog.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    same_as_sql(QUERIES[name](spark, data), SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    assert bool(rows(df)) == (name not in EMPTY)
