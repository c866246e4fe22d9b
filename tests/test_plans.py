"""The physical plans of the operators that handle the most rows."""

import pytest
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.operators import clusters, terms
from lexifold.operators.lookup import BroadcastBound
from lexifold.session import materialise
from lexifold.sources import tables
from tests.conftest import plan_of


@pytest.fixture
def stage(spark, corpus, tmp_path):
    return tables.save_stage(corpus.withColumn("lang", F.lit("en")), str(tmp_path / "docs"))


def test_counting_words_of_a_document_moves_nothing(stage):
    plan = plan_of(terms.bow_counts(terms.instances(terms.tokenize(stage))))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan


def test_counts_are_computed_once(stage):
    plan = plan_of(terms.explode_terms(terms.instances(terms.tokenize(stage))))
    assert plan.count("sort_array") == 1


def test_vocabulary_combines_before_its_only_shuffle(stage):
    plan = plan_of(terms.vocabulary(terms.instances(terms.tokenize(stage))))
    assert plan.count("Exchange") == 1 and "partial_count" in plan
    assert "doc_id" not in plan.split("ReadSchema:")[1]


def test_counting_documents_reads_no_column(stage):
    assert "ReadSchema: struct<>" in plan_of(stage.select(T.clean_text(F.col("text"))).agg(F.count(F.lit(1))))


def test_cluster_counts_move_only_compact_rows(spark, stage):
    inst = materialise(terms.instances(terms.tokenize(stage)), "inst")
    words = materialise(terms.vocabulary(inst), "v")
    paths = words.select(F.lit("01").alias("path"), F.col("token").alias("word"))
    bridge = clusters.cluster_bridge(paths, words)
    plan = plan_of(clusters.cluster_counts(inst, bridge))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_cluster_counts_beyond_the_bound_move_no_prefixes(spark, stage):
    inst = materialise(terms.instances(terms.tokenize(stage)), "inst")
    words = materialise(terms.vocabulary(inst), "v")
    paths = words.select(F.lit("01").alias("path"), F.col("token").alias("word"))
    bridge = clusters.cluster_bridge(paths, words)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = clusters.cluster_counts(inst, bridge, bound=BroadcastBound(rows=1))
        plan = plan_of(counts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line.split("hashpartitioning(", 1)[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("path" in names or "feature" in names for names in moved)
    assert sum(name.startswith("doc_id") for name in moved) == 1
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, clusters.cluster_counts(inst, bridge).collect()))


def test_cluster_counts_of_a_bucketed_table_move_nothing(spark, stage, tmp_path):
    inst = terms.instances(terms.tokenize(stage))
    words = materialise(terms.vocabulary(inst), "v")
    paths = words.select(F.lit("01").alias("path"), F.col("token").alias("word"))
    bridge = clusters.cluster_bridge(paths, words)
    table = tables.save_bucketed(inst, "inst_bucketed", str(tmp_path / "bucketed"), 4)
    counts = clusters.cluster_counts(table, bridge, bucketed=True)
    plan = plan_of(counts)
    assert "Exchange hashpartitioning" not in plan
    expected = clusters.cluster_counts(inst, bridge).collect()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, expected))
    spark.sql("drop table inst_bucketed")


def test_small_inputs_are_spread_and_large_ones_are_left(spark, stage, tmp_path):
    stage.coalesce(1).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    assert "REPARTITION" in plan_of(tables.read_documents(spark, str(tmp_path / "one")))
    cores = spark.sparkContext.defaultParallelism
    spark.range(5000).selectExpr("id as doc_id", "'x' as text").repartition(4 * cores).write.parquet(
        str(tmp_path / "many" / "documents.parquet")
    )
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 * 1024 * 1024))
    try:
        assert "REPARTITION" not in plan_of(tables.read_documents(spark, str(tmp_path / "many")))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
