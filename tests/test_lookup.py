import pytest
from pyspark.sql import functions as F

from lexifold.operators.lookup import BroadcastBound, lookup
from tests.conftest import plan_of


@pytest.fixture
def tables(spark):
    # one key holds a third of all facts
    facts = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), (F.col("id") % 400).cast("string"))).alias("token"),
    )
    dim = facts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("size", F.length("token"))
    return facts, dim


@pytest.mark.parametrize("rows", [1_000_000, 100, 10, 1, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_every_bound_gives_the_plain_join(tables, rows, how):
    facts, dim = tables
    facts = facts.unionByName(facts.limit(1).withColumn("token", F.lit("unknown")))
    expected = sorted(map(tuple, facts.join(dim, "token", how).select("doc_id", "token", "size").fillna(-1).collect()))
    found = lookup(facts, dim, ["token"], "df", how, BroadcastBound(rows=rows))
    assert sorted(map(tuple, found.select("doc_id", "token", "size").fillna(-1).collect())) == expected


def test_hot_key_is_broadcast_and_rare_keys_are_shuffled(spark, tables):
    facts, dim = tables
    found = lookup(facts, dim, ["token"], "df", bound=BroadcastBound(rows=10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" in plan


def test_byte_bound_counts_long_keys(spark):
    dim = spark.createDataFrame([("x" * 5000, 4), ("y", 4)], "token string, df bigint")
    facts = dim.select("token")
    found = lookup(facts, dim, ["token"], "df", bound=BroadcastBound(bytes=1000))
    assert "LeftAnti" in plan_of(found)
    assert found.count() == 2


def test_one_fact_may_meet_many_rows(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, token string")
    dim = spark.createDataFrame([("a", "0", 9), ("a", "1", 9), ("b", "0", 1)], "token string, path string, df bigint")
    for rows in (10, 2, 0):
        found = lookup(facts, dim, ["token"], "df", bound=BroadcastBound(rows=rows))
        assert sorted((r["doc_id"], r["path"]) for r in found.collect()) == [(1, "0"), (1, "1"), (2, "0")]


@pytest.mark.parametrize("how", ["right", "full", "left_anti", "left_semi", "cross"])
def test_other_kinds_of_join_are_refused(tables, how):
    facts, dim = tables
    with pytest.raises(ValueError, match="inner or left"):
        lookup(facts, dim, ["token"], "df", how)
