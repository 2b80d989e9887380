import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strataquery.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        connection.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return connection


def plain(value):
    """A value that compares alike from both engines."""
    if isinstance(value, float):
        return "nan" if value != value else round(value, 7) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 7)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)


def same_as_sql(df, sql, duck):
    columns = sorted(df.columns)
    result = duck.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert rows(df, *[f"`{c}`" for c in columns]) == expected
