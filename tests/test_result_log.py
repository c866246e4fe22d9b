"""The result log: written twice, broken off, and by different runs."""

import pytest
from pyspark.sql import functions as F

from lexifold.plans.crossval import log_report
from lexifold.sources import results


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, float(i % 2), float(i % 3 == 0)) for i in range(12)], "doc_id long, real double, predicted double")


def test_rows_count_once_however_often_they_are_logged(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    results.log_results(rows, path, "a", "predictions", c=0.1)
    results.log_results(rows.limit(5), path, "b", "predictions", c=1.0, note="first try")
    results.log_results(rows.filter("doc_id < 7"), path, "b", "predictions", c=2.0)
    results.log_results(rows, path, "b", "other")
    results.write_attempt(rows, path)
    found = results.read_log(spark, path, "predictions")
    assert {r["run_id"]: r["count"] for r in found.groupBy("run_id").count().collect()} == {"a": 12, "b": 7}
    assert {(r["run_id"], r["c"]) for r in found.collect()} == {("a", 0.1), ("b", 2.0)}
    assert results.committed(spark, path).count() == 3
    with pytest.raises(ValueError, match="nothing is logged"):
        results.read_log(spark, path, "missing")


def test_an_attempt_that_breaks_off_leaves_the_last_one(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    results.log_results(rows, path, "a", "predictions")
    broken = rows.withColumn("real", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        results.log_results(broken, path, "a", "predictions")
    assert results.read_log(spark, path, "predictions").count() == 12


def test_reports_are_logged_with_their_measures(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    report = rows.withColumns({"stage": F.when(F.col("doc_id") < 8, "train").otherwise("validation"), "fold": F.lit(0)})
    for _ in range(2):
        log_report(report, path, "run", c=0.5)
    assert results.read_log(spark, path, "predictions").count() == 12
    overall = results.read_log(spark, path, "overall_metrics").collect()
    assert {r["stage"] for r in overall} == {"train", "validation"} and {r["c"] for r in overall} == {0.5} and len(overall) == 2
    assert results.read_log(spark, path, "class_metrics").count() == 4
