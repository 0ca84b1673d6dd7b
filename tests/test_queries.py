"""Every registered query against its SQL on the smallest test tables."""

import sys

import duckdb
import pytest
from conftest import DATA, ROOT

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare  # noqa: E402
from queries import TABLES, all_queries  # noqa: E402

FOLDER = DATA / "sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, db, name):
    query, sql = all_queries()[name]
    ours = query(spark, str(FOLDER)).toPandas()
    if sql:
        verdict = compare(ours, db.execute(sql).df())
        # an empty result carries no value types to compare
        assert verdict == "same" or (verdict.startswith("same") and ours.empty), verdict


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"Segment", "customers", "revenue"}
    assert entry.queries().keys() >= entry.oracle_sql().keys()
