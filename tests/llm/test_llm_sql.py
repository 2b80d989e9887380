"""Queries of this subpackage on the test tables: against SQL where there is some, else that they run and keep to their form."""

import pytest
from conftest import rows, same_as_sql

from strataquery.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    same_as_sql(QUERIES[name](spark, data), SQL[name], duck)


@pytest.mark.parametrize(("name", "columns"), [("p2_found", ["author_id_a", "author_id_b"]), ("p7_found", ["doc_id", "item_id"]), ("p8_found", ["doc_id"])])
def test_columns_and_cases(spark, data, name, columns):
    df = QUERIES[name](spark, data)
    got = rows(df)
    assert df.columns == columns and len(got) == len(set(got))


@pytest.mark.parametrize("name", ["p1_elite", "p2_entities", "p6_lengths"])
def test_runs(spark, data, name):
    rows(QUERIES[name](spark, data))
