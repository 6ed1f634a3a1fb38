"""Every registered query against its SQL counterpart."""

import duckdb
import pytest

import __spark_entry__ as contract
from bibspan.fixtures.queries import ORACLES, PLANS, QUERIES
from tests.conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def in_order(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in found), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(data, sql, name):
    """Datasets are shared by the queries of the session, to keep this quick."""
    df = PLANS[name](data)
    expected = sql.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    expected = expected.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.columns, df.collect()) == in_order(columns, expected)


@pytest.mark.parametrize("name", ["rq5_internal", "title_match", "scan_zip_shards"])
def test_query_from_raw_tables(spark, sql, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    expected = sql.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert in_order(df.columns, df.collect()) == in_order(columns, expected.fetchall())


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["iris_type", "len"] and found.count() > 0
