"""Every registered query against its SQL, both over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from feedskein.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "int64", "string": "string", "boolean": "bool", "timestamp_ntz": "timestamp[us]"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return sorted(([r[n] for n in names] for r in table.to_pylist()), key=lambda r: [(x is None, str(x)) for x in r])


def test_every_query_has_its_sql():
    assert QUERIES.keys() <= contract.oracle_sql().keys()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    frame = contract.queries()[name](spark, FOLDER)
    expected = oracle.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert sorted(frame.columns) == sorted(expected.column_names)
    for column, kind in frame.dtypes:
        assert TYPES[kind] == str(expected.schema.field(column).type), column
    assert rows(frame.toArrow()) == rows(expected)


@pytest.mark.parametrize("name", [
    "articles_all", "ingest_rejects", "state_fold", "actions_applied", "feeds_added", "feeds_lookup",
    "feeds_removed_cascade", "parse_articles", "refresh_report", "discover_fallback", "subscriptions",
])
def test_query_without_broadcast(spark, oracle, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query(spark, oracle, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
