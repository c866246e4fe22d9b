"""Contiguous shards of nearly equal bytes from global prefix sums.

Documents are ordered by (doc_id, CRC-32, size). Range partitions of that order
are written, each gives its total, the totals are summed up, and a running sum
inside each partition completes the global prefix sum. The shards are cut at
equal targets of it. Only three numbers per document are moved, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.common import empty_if_null, fresh, materialise, partition_offsets

LAW = "bytes"
ORDER = ("doc_id", "text_crc32", "size")


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = 16, partitions: int | None = None) -> DataFrame:
    """One row ``(doc_id, size, text_crc32, shard, slot)`` per row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 1 (null: 1, CRC-32 of nothing).
    A document belongs to the shard in which its first byte falls, so shards
    differ from the target by less than two documents. Null ids come first,
    repeated rows follow each other, an empty table gives no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = docs.select(
        F.col("doc_id"), F.crc32(empty_if_null().cast("binary")).alias("text_crc32"), _size("text").alias("size")
    )
    laid = materialise(
        light.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()), "shard_order"
    )
    totals = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = F.broadcast(partition_offsets(totals, "part", ["bytes", "rows"]))
    ordered = Window.partitionBy("part").orderBy(*ORDER)
    inside = F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = laid.withColumn("_inside", inside).withColumn("_row", F.row_number().over(ordered)).join(offsets, "part")
    start = F.col("bytes_before") + F.col("_inside")
    shard = F.floor((start * shards).cast("decimal(38,0)") / F.col("bytes_all")).cast("int")
    placed = materialise(
        numbered.select(*ORDER, shard.alias("shard"), (F.col("rows_before") + F.col("_row") - 1).alias("rank")),
        "shard_rows",
    )
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("_first")))
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("_first")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Write whole rows of ``docs`` to ``path/shard=…`` and read them back.

    A shard is an interval of the order, so its first key is all that is needed to
    place a document; ``shards`` such keys are fetched. Rows alike in id, size and
    CRC-32 stay together.
    """
    firsts = (
        shard_documents(docs, shards)
        .groupBy("shard")
        .agg(F.min(F.struct(*ORDER)).alias("first"))
        .orderBy("shard")
        .collect()
    )
    schema = docs.schema["doc_id"].dataType
    key = F.struct(
        F.col("doc_id"), F.crc32(empty_if_null().cast("binary")).alias("text_crc32"), _size("text").alias("size")
    )
    placed = F.lit(0)
    for row in firsts:
        bound = F.struct(
            F.lit(row["first"]["doc_id"]).cast(schema).alias("doc_id"),
            F.lit(row["first"]["text_crc32"]).cast("long").alias("text_crc32"),
            F.lit(row["first"]["size"]).cast("long").alias("size"),
        )
        placed = F.when(key >= bound, F.lit(row["shard"])).otherwise(placed)
    name = fresh(docs, "shard")
    spread = docs.withColumn(name, placed).repartition(name, F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    spread.sortWithinPartitions(name, "doc_id").write.partitionBy(name).parquet(path)
    return docs.sparkSession.read.parquet(path)
