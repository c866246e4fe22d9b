"""All registered queries on the smallest tables, against their SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from lexifold.checks import oracle, spark_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = spark_queries.QUERIES, oracle.ORACLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "labels", "embeddings", "benchmark"):
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def ordered(frame):
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if frame[column].dtype.kind == "f":
            frame[column] = frame[column].round(6) + 0.0
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    expected = duck.sql(SQL[name]).df()
    assert len(found) > 0
    pd.testing.assert_frame_equal(ordered(found), ordered(expected), check_dtype=False, rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", ["bow_tfidf", "tfidf_per_set", "brown_plus_bow_tfidf", "brown_partial_counts"])
def test_query_equals_its_sql_when_little_is_broadcast(spark, duck, name):
    spark.conf.set("spark.lexifold.broadcast.rows", "100")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query_equals_its_sql(spark, duck, name)
    finally:
        spark.conf.unset("spark.lexifold.broadcast.rows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_query_has_a_statement():
    assert set(SQL) == set(QUERIES)


def test_flagship_beats_the_majority(spark):
    rows = entry_points.entry(spark).filter("stage = 'cumulative'").collect()
    right, total = sum(r["tp"] for r in rows), sum(r["tp"] + r["fn"] for r in rows)
    majority = max(r["tp"] + r["fn"] for r in rows)
    assert right > majority and total == 200
