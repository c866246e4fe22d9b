"""Parquet tables: inputs, and the stages of the work saved between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexifold.session import materialise


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """The documents, spread by key if the files give fewer splits than there are cores.

    Large inputs have more splits than cores and are not moved.
    """
    docs = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, key) if docs.rdd.getNumPartitions() < cores else docs


def save_stage(df: DataFrame, path: str) -> DataFrame:
    """Write instances, features or vectors and return the table as read back.

    Give the training and the test set a path each.
    """
    return materialise(df, "stage", path)


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """Write a stage as a table bucketed by document and return it.

    Grouping by document and joining two such tables of as many buckets then
    needs no shuffle.
    """
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved stage."""
    return spark.read.parquet(path)
