"""Document frequencies kept up to date as documents arrive and go.

Every batch adds signed counts: plus for documents that arrive, minus for documents that
go. Frequencies as of a batch are the sums up to it, so nothing is counted again, and
a compaction writes them as one table from which later sums start. Batches are committed
like versions of a dictionary: one writer wins each number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.operators.terms import vocabulary
from lexifold.session import materialise
from lexifold.sources.dictionary import VersionTaken, commit_words, versions

COUNTS = "feature string, df long"


def record_batch(spark: SparkSession, path: str, inst: DataFrame, leaves: bool = False, tries: int = 5) -> int:
    """Add the documents ``inst`` to the ledger, or with ``leaves`` take them out; returns the batch.

    A document that is taken out must have been put in before; the caller sees to that.
    """
    sign = -1 if leaves else 1
    inst = materialise(inst.select("doc_id", "terms"), "batch")
    counts = vocabulary(inst).select(F.col("token").alias("feature"), (F.col("df") * sign).alias("df"))
    attempt = uuid.uuid4().hex
    rows = materialise(counts, "counts", f"{path}/attempts/{attempt}").count()
    docs = sign * inst.count()
    for _ in range(tries):
        told = versions(spark, path)
        record = {"attempt": attempt, "words": rows, "total": max(((v, t["total"]) for v, t in told.items() if t), default=(0, 0))[1] + docs}
        batch = max(told, default=0) + 1
        try:
            commit_words(spark, path, batch, record)
            return batch
        except VersionTaken:
            continue
    raise VersionTaken(f"other writers were first {tries} times")


def _sums(spark: SparkSession, path: str, batch: int, told: dict[int, dict | None]) -> DataFrame:
    """Frequencies as of a batch, from the last compaction before it and the batches since."""
    done = {b: t for b, t in versions(spark, f"{path}/compacted").items() if t and b <= batch}
    start = max(done, default=0)
    names = [f"{path}/attempts/{t['attempt']}" for b, t in told.items() if t and t["words"] and start < b <= batch]
    names += [f"{path}/attempts/{done[start]['attempt']}"] if start else []
    if not names:
        return spark.createDataFrame([], COUNTS)
    sums = spark.read.schema(COUNTS).parquet(*names).groupBy("feature").agg(F.sum("df").alias("df"))
    return sums.filter(F.col("df") != 0)


def compact(spark: SparkSession, path: str) -> int:
    """Write the frequencies as of the last batch as one table; later reads start from it. Returns the batch."""
    told = versions(spark, path)
    batch = max(told, default=0)
    if not batch or batch in versions(spark, f"{path}/compacted"):
        return batch
    attempt = uuid.uuid4().hex
    count = materialise(_sums(spark, path, batch, told), "counts", f"{path}/attempts/{attempt}").count()
    commit_words(spark, f"{path}/compacted", batch, {"attempt": attempt, "words": count, "total": 0})
    return batch


def idf_as_of(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """``(feature, df, idf)`` as of a batch, by default the last; features whose documents are all gone are left out."""
    told = versions(spark, path)
    batch = max(told, default=0) if batch is None else batch
    if batch and batch not in told:
        raise ValueError(f"there is no batch {batch}")
    total = max(((b, t["total"]) for b, t in told.items() if t and b <= batch), default=(0, 0))[1]
    n: Column = F.lit(total)
    return _sums(spark, path, batch, told).withColumn("idf", T.inverse_weight(n, F.col("df")))


