"""A dictionary of words that only grows: a word keeps its number when documents arrive.

A version adds the words that the versions before it lack, numbered on from their count.
Words are written to a folder of their own first. A version exists once its commit file
does, which is created only if there is none yet, so of two writers that start from the
same version one wins, and the other is told to look again. A writer that dies leaves
at most a folder that nobody reads, or a version without words.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.operators.numbering import number_by_digest
from lexifold.session import materialise

WORDS = "token string, idx long, version int"


class VersionTaken(RuntimeError):
    """Another writer has committed this version; read the dictionary again and add what is still missing."""


def _file(spark: SparkSession, path: str):
    """A path and its file system."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> dict[int, dict | None]:
    """What every version says of itself: its ``attempt``, its ``words``, and the ``total`` with it.

    A version whose writer died before it said so has nothing.
    """
    folder, system = _file(spark, f"{path}/commits")
    if not system.exists(folder):
        return {}
    taken = sorted(int(status.getPath().getName()) for status in system.listStatus(folder))
    rows = spark.read.option("wholetext", True).text(f"{path}/commits").select("value", F.input_file_name().alias("file")).collect()
    told = {int(r["file"].rsplit("/", 1)[1]): json.loads(r["value"]) for r in rows if r["value"].strip()}
    return {version: told.get(version) for version in taken}


def read_dictionary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(token, idx, version)`` as of a version, by default the last; numbers run from 0 without gaps."""
    told = versions(spark, path)
    if version is not None and version not in told:
        raise ValueError(f"there is no version {version}")
    names = [t["attempt"] for v, t in told.items() if t and t["words"] and (version is None or v <= version)]
    if not names:
        return spark.createDataFrame([], WORDS)
    return spark.read.schema(WORDS).parquet(*[f"{path}/attempts/{name}" for name in names])


def prepare_words(spark: SparkSession, path: str, tokens: DataFrame) -> tuple[int, dict]:
    """Write the tokens that the dictionary lacks, and return the version to commit them as and its record.

    Null tokens are left aside, repeated ones are one word. New words are numbered in
    the order of their digest.
    """
    told = versions(spark, path)
    version, total = max(told, default=0) + 1, max((t["total"] for t in told.values() if t), default=0)
    wanted = tokens.select("token").filter("token is not null").distinct()
    new = wanted.join(read_dictionary(spark, path).select("token"), "token", "left_anti") if total else wanted
    new = materialise(new, "new_words")
    attempt = uuid.uuid4().hex
    numbered = number_by_digest(new, F.col("token"), ["token"], out="idx")
    rows = numbered.select("token", (F.col("idx") + total).alias("idx"), F.lit(version).alias("version"))
    count = materialise(rows, "words", f"{path}/attempts/{attempt}").count()
    return version, {"attempt": attempt, "words": count, "total": total + count}


def commit_words(spark: SparkSession, path: str, version: int, record: dict) -> None:
    """Make prepared words a version; :class:`VersionTaken` if another writer was first."""
    file, system = _file(spark, f"{path}/commits/{version:08d}")
    try:
        stream = system.create(file, False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            raise VersionTaken(f"version {version} is taken") from error
        raise
    stream.write(bytearray(json.dumps(record).encode()))
    stream.close()


def add_words(spark: SparkSession, path: str, tokens: DataFrame, tries: int = 5) -> int:
    """Add what is missing of ``tokens`` as a new version, after other writers if need be; returns the version."""
    for _ in range(tries):
        version, record = prepare_words(spark, path, tokens)
        try:
            commit_words(spark, path, version, record)
            return version
        except VersionTaken:
            continue
    raise VersionTaken(f"other writers were first {tries} times")
