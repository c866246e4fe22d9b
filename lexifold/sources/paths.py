"""Files of word-cluster paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_cluster_paths(lines: DataFrame, value: str = "value") -> DataFrame:
    """First and second field of each line as ``(path, word)``; more fields are ignored.

    Every single blank separates fields. Lines with fewer than two fields are skipped.
    """
    fields = F.split(F.col(value), r"[ \t\n\x0B\f\r]")
    return (
        lines.select(F.get(fields, F.lit(0)).alias("path"), F.get(fields, F.lit(1)).alias("word"))
        .filter(F.col("word").isNotNull())
    )


def bad_cluster_paths(lines: DataFrame, value: str = "value") -> DataFrame:
    """Quarantine: the lines with fewer than two fields."""
    return lines.filter(F.col(value).isNull() | (F.size(F.split(F.col(value), r"[ \t\n\x0B\f\r]")) < 2))


def read_cluster_paths(spark: SparkSession, path: str) -> DataFrame:
    """Cluster paths from a text file."""
    return parse_cluster_paths(spark.read.text(path))


def write_cluster_paths(paths: DataFrame, path: str) -> None:
    """Cluster paths to text files, tab separated."""
    paths.select(F.concat_ws("\t", "path", "word").alias("value")).write.mode("overwrite").text(path)
