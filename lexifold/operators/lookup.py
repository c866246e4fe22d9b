"""Joining a large fact table to a keyed table whose size is not known in advance.

Word-like keys are skewed: a few keys hold most of the fact rows, and the keyed
table itself may be too large to broadcast. :func:`lookup` measures the keyed
table first. If it fits the bounds, it is broadcast whole. If not, its most
frequent keys, as many as fit, are broadcast, and only the fact rows with rarer
keys are shuffled. No row is dropped on either way, and no key of the table is
hot in the shuffle, because every hot key is in the broadcast part. A hot key of
the facts that the table lacks can be listed in it with empty columns; where it
is not, adaptive execution splits its partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BroadcastBound:
    """Largest table that is broadcast."""

    rows: int = 1_000_000
    bytes: int = 64 * 1024 * 1024

    @staticmethod
    def of(spark: SparkSession) -> BroadcastBound:
        """The bound of the session, ``spark.lexifold.broadcast.rows`` and ``.bytes``."""
        default = BroadcastBound()
        return BroadcastBound(
            int(spark.conf.get("spark.lexifold.broadcast.rows", str(default.rows))),
            int(spark.conf.get("spark.lexifold.broadcast.bytes", str(default.bytes))),
        )


def _band(weight: str) -> Column:
    return F.floor(F.log2(F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)))).cast("int")


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(0)
    for field in df.schema.fields:
        text = field.dataType.typeName() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(field.name), F.lit(0)) + 16 if text else F.lit(8))
    return size


def _cut(dim: DataFrame, weight: str, bound: BroadcastBound) -> int:
    """Lowest frequency band of the broadcast part; at most 64 rows are fetched."""
    bands = (
        dim.groupBy(_band(weight).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(dim)).alias("b"))
        .collect()
    )
    rows = size = 0
    cut = 64
    for band in sorted(bands, key=lambda r: -r["band"]):
        rows += band["n"]
        size += band["b"]
        if rows > bound.rows or size > bound.bytes:
            return cut
        cut = band["band"]
    return 0


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    weight: str,
    how: str = "inner",
    bound: BroadcastBound | None = None,
) -> DataFrame:
    """Join ``facts`` to ``dim`` on ``keys``.

    ``dim`` should be a written table (it is measured here), and ``weight`` is
    its column with the frequency of the key among the facts. ``how`` is ``inner``
    or ``left``, the kinds that keep the same rows beyond the bound.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    keys = list(keys)
    frequent, rare = split_table(dim, weight, bound)
    if rare is None:
        return facts.join(F.broadcast(frequent), keys, how)
    near = facts.join(F.broadcast(frequent), keys, "inner")
    return near.unionByName(rarer(facts, frequent, keys).join(rare, keys, how))


def split_table(dim: DataFrame, weight: str, bound: BroadcastBound | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``dim`` to broadcast, and the others, or None if it is within the bound."""
    cut = _cut(dim, weight, bound or BroadcastBound.of(dim.sparkSession))
    if cut == 0:
        return dim, None
    return dim.filter(_band(weight) >= cut), dim.filter(_band(weight) < cut)


def rarer(facts: DataFrame, frequent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The facts whose key is not in the broadcast part."""
    return facts.join(F.broadcast(frequent.select(*keys)), list(keys), "left_anti")
