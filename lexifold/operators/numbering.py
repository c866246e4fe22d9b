"""Exact consecutive numbers without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.session import materialise

_BUCKET = "__bucket"
_OFFSET = "__offset"


def _number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Number rows by (bucket, order) from 0, given that buckets follow the order.

    Rows are sorted bucket by bucket in parallel. The row counts of the buckets,
    whose number is fixed, are summed up to give each bucket its first number.
    """
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(_BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(_BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_OFFSET))
    )
    within = Window.partitionBy(_BUCKET).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(within))
        .join(F.broadcast(offsets), _BUCKET)
        .withColumn(out, (F.col(_OFFSET) + F.col("__rank") - 1).cast("bigint"))
        .drop(_BUCKET, _OFFSET, "__rank")
    )


def number_by_digest(
    df: DataFrame, text: Column, ties: Sequence[str], out: str = "position", hex_digits: int = 4
) -> DataFrame:
    """Number rows from 0 in the order of ``md5(text)``, then of ``ties``.

    Equals ``row_number() over (order by md5(text), ties) - 1``. The leading hex
    digits of the digest are the buckets: they follow the order and are evenly
    filled as long as ``text`` is unique. There are at most ``16 ** hex_digits``.
    """
    digested = df.withColumn("__digest", F.md5(text.cast("binary"))).withColumn(
        _BUCKET, F.substring("__digest", 1, hex_digits)
    )
    return _number(digested, ["__digest", *ties], out).drop("__digest")


def number_in_order(df: DataFrame, key: str, out: str = "position", buckets: int | None = None) -> DataFrame:
    """Number rows from 0 in the order of a numeric, unique ``key``.

    The rows are written in as many ranges of the key as ``buckets`` says, by default
    the number of shuffle partitions, and sorted range by range.
    """
    spark = df.sparkSession
    ranges = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, key).withColumn(_BUCKET, F.spark_partition_id())
    return _number(materialise(ranged, "ranges"), [key], out)


def assign_folds(
    docs: DataFrame, k: int, seed: int = 0, key: str = "doc_id", drop_tail: bool = False
) -> DataFrame:
    """Fold numbers ``0..k-1`` after a seeded shuffle; sizes differ by at most 1.

    With ``drop_tail`` all folds get the same size, and the last ``n mod k``
    documents of the shuffled order get no fold and are left out.
    """
    shuffled = number_by_digest(
        docs, F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), [key], out="position"
    )
    if drop_tail:
        total = docs.agg(F.count(F.lit(1))).scalar()
        shuffled = shuffled.filter(F.col("position") < total - total % k)
    return shuffled.withColumn("fold", (F.col("position") % k).cast("int"))


def in_fold(df: DataFrame, fold: int) -> DataFrame:
    """Rows held out in ``fold``."""
    return df.filter(F.col("fold") == fold)


def not_in_fold(df: DataFrame, fold: int) -> DataFrame:
    """Rows to train on when ``fold`` is held out."""
    return df.filter(F.col("fold") != fold)
