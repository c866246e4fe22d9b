"""Helpers that several operators share: splits, sizes, and joins that survive hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexifold.session import materialise, scratch_path
from lexifold.sources.tables import read_table

__all__ = [
    "JoinBound", "components", "drop_documents", "empty_if_null", "fresh", "held_out", "join_groups", "learnable",
    "in_pieces", "materialise", "partition_offsets", "read_table", "release_memory", "scratch_path", "small_batches",
]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether ``crc32(doc_id as text) mod 5`` is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Whether a row may be learned from: it has an id and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def empty_if_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_memory() -> None:
    """Give freed memory back to the system, as an idle worker would otherwise keep it from the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most ``most`` bytes in column ``text``, or of one row.

    What a task holds at a time then follows neither the rows of a batch nor their length.
    """
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0)).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(low, high - low)
            release_memory()
            low = high


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While tables are written inside, Python gets at most ``rows`` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class JoinBound:
    """What :func:`join_groups` broadcasts at most, and when a key is hot.

    A key is hot if it holds at least one in ``hot_share`` of the rows, so that
    there are never more than ``hot_share`` hot keys.
    """

    bytes: int = 32 * 1024 * 1024
    hot_share: int = 1000
    salts: int = 64


def join_groups(
    facts: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    rows: str,
    salt_by: str,
    row_bytes: Column | None = None,
    bound: JoinBound | None = None,
) -> DataFrame:
    """Inner join of ``facts`` to one row per key, whatever the sizes of the groups.

    ``groups`` should be a written table; ``rows`` is its column with the number
    of facts of the key, and ``row_bytes`` estimates the size of a row. Groups are
    broadcast if their measured size is within the bound. Beyond it both sides are
    shuffled, and the facts of hot keys are spread over salts by ``salt_by``.
    """
    bound = bound or JoinBound()
    keys = list(keys)
    size = F.lit(16 * len(groups.columns)) if row_bytes is None else row_bytes
    total = groups.agg(F.sum(rows).alias("n"), F.sum(size).alias("b")).first()
    if (total["b"] or 0) <= bound.bytes:
        return facts.join(F.broadcast(groups), keys)
    hot = groups.filter(F.col(rows) * bound.hot_share >= F.lit(total["n"])).select(*keys, F.lit(True).alias("_hot"))
    spread = F.pmod(F.xxhash64(salt_by), F.lit(bound.salts)).cast("int")
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(bound.salts - 1))).otherwise(F.array(F.lit(0)))
    copied = groups.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies))
    return salted.drop("_hot").join(copied.drop("_hot"), [*keys, "_salt"]).drop("_salt")


def partition_offsets(totals: DataFrame, part: str, sums: Sequence[str]) -> DataFrame:
    """Per partition what all partitions before it hold, as ``<sum>_before``, and ``<sum>_all``.

    ``totals`` has one row per partition of a written table, so the sum that runs
    over all of it is bounded by the number of partitions and not by the rows.
    """
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [F.coalesce(F.sum(s).over(before), F.lit(0)).cast("long").alias(f"{s}_before") for s in sums]
    return totals.select(part, *columns, *[F.sum(s).over(everything).cast("long").alias(f"{s}_all") for s in sums])


def drop_documents(docs: DataFrame, dropped: DataFrame, bound_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the documents whose ``doc_id`` is in ``dropped`` (a written table).

    The ids are broadcast if there are at most ``bound_rows`` of them, else both
    sides are shuffled. Null ids match null ids. All columns of ``docs`` stay.
    """
    gone, many = fresh(docs, "_gone"), dropped.count() > bound_rows
    ids = dropped.select(F.col("doc_id").alias(gone)).distinct()
    ids = ids.hint("merge") if many else F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[gone]), "left_anti")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the least node reachable.

    Large-star and small-star steps alternate until nothing changes. Every round is
    written to the shared folder; only counts come back. A node with very many
    neighbours is a hot key, so its joins go through :func:`join_groups`.
    """
    pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    for _ in range(max_rounds):
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "star_least")
        bytes_ = F.lit(96)
        large = join_groups(both.filter("b > a"), least, ["a"], "n", salt_by="b", row_bytes=bytes_)
        large = materialise(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large_stars")
        floor = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "star_floor")
        following = materialise(
            join_groups(large, floor, ["a"], "n", salt_by="b", row_bytes=bytes_)
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.b").alias("b"))
            .filter("a <> b")
            .distinct(),
            "stars",
        )
        same = following.count() == pairs.count() and following.join(pairs, ["a", "b"], "left_anti").isEmpty()
        pairs = following
        if same:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
