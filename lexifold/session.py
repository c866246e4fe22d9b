"""Where intermediate tables of a job are written.

A cluster names its shared folder in ``spark.checkpoint.dir``. Only when that
setting is missing, on a local master, is a folder of this machine used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_RUN_KEY = "spark.lexifold.run"
_REMOVE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _configured_root(spark: SparkSession) -> str | None:
    return spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="lexifold-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = _configured_root(spark)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that every executor can reach")
    return _local_root()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of the run, or else below :func:`scratch_root`."""
    folder = spark.conf.get(_RUN_KEY, "") or f"{scratch_root(spark)}/lexifold"
    return f"{folder}/{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A folder for all intermediate tables of one run, removed at its end.

    Write the results elsewhere before the block ends. Threads of the session
    share the folder; a run inside a run uses that of the outer one.
    """
    outer = spark.conf.get(_RUN_KEY, "")
    if outer:
        yield outer
        return
    folder = f"{scratch_root(spark)}/lexifold/run-{uuid.uuid4().hex}"
    spark.conf.set(_RUN_KEY, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(_RUN_KEY)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a DataFrame that reads the files.

    This cuts the lineage, survives the loss of executors and gives later plans
    a size from the file footers.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside the block remove what they shuffled as soon as they are there."""
    before = spark.conf.get(_REMOVE_KEY)
    spark.conf.set(_REMOVE_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_KEY, before)


def discard(df: DataFrame) -> None:
    """Remove the files of a table of :func:`materialise` that nothing reads any more.

    Shuffles that nothing refers to are given up, too; otherwise they stay on disk until the driver's memory is next tidied.
    """
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()
