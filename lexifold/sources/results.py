"""Predictions and measurements on disk."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_SCHEMA = "real double, predicted double"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated file with one header line and the columns real and predicted."""
    return spark.read.schema(PREDICTION_SCHEMA).option("sep", "\t").option("header", True).csv(path)


def write_predictions_file(predictions: DataFrame, path: str) -> None:
    """Tab-separated files that :func:`read_predictions` can read."""
    (
        predictions.select(F.col("real").cast("double"), F.col("predicted").cast("double"))
        .write.mode("overwrite")
        .option("sep", "\t")
        .option("header", True)
        .csv(path)
    )


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = ("run_id", "stage")) -> None:
    """Append predictions or measurements, one folder per run and stage."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def tag_run(df: DataFrame, run_id: str, **settings: object) -> DataFrame:
    """Add the run and its settings as columns."""
    return df.withColumns({"run_id": F.lit(run_id), **{k: F.lit(v) for k, v in settings.items()}})


# ---- a log that may be written twice ----------------------------------------

MANIFEST = "run_id string, stage string, attempt string, committed_at long"
MAX_ATTEMPTS = 100_000


def write_attempt(df: DataFrame, path: str) -> str:
    """Write rows to a folder of their own below ``path``; until it is committed, no reader sees it."""
    attempt = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{path}/attempts/{attempt}")
    return attempt


def commit_attempt(spark: SparkSession, path: str, run_id: str, stage: str, attempt: str) -> None:
    """Make an attempt what readers see for this run and stage, in place of earlier ones."""
    row = [(run_id, stage, attempt, time.time_ns())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def log_results(df: DataFrame, path: str, run_id: str, stage: str, **settings: object) -> None:
    """Log predictions or measurements of a run and stage, with its settings as columns.

    The same run and stage may be logged again, and a job may die at any moment: rows
    count once, those of the last attempt that was written to its end.
    """
    rows = df.drop("run_id", "stage_logged").withColumns({k: F.lit(v) for k, v in settings.items()})
    commit_attempt(df.sparkSession, path, run_id, stage, write_attempt(rows, path))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, stage, attempt)`` of the attempts that count."""
    last = F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").groupBy("run_id", "stage").agg(last)


def read_log(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """All rows logged for a stage, each with its ``run_id``; columns that some runs lack are null there."""
    runs = committed(spark, path).filter(F.col("stage") == stage)
    names = [r["attempt"] for r in runs.select("attempt").limit(MAX_ATTEMPTS + 1).collect()]
    if len(names) > MAX_ATTEMPTS:
        raise ValueError(f"more than {MAX_ATTEMPTS} runs; read the log in parts")
    if not names:
        raise ValueError(f"nothing is logged for stage {stage}")
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{path}/attempts/{name}" for name in names])
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.withColumn("attempt", folder).join(F.broadcast(runs.select("run_id", "attempt")), "attempt").drop("attempt")
