"""libSVM text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_libsvm(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line per document: its label, then ascending ``index:value`` pairs from 1."""
    vectors.select("label", "features").write.mode(mode).format("libsvm").save(path)


def read_libsvm(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Rows ``(label, features)`` from libSVM files."""
    return spark.read.format("libsvm").option("numFeatures", str(n_features)).load(path)
