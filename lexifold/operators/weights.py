"""Log-scaled term weights times inverse document frequency.

Fitting is one aggregation over (document, feature) rows; its result is written
once and then looked up, so the weights need no second count of the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.operators.lookup import BroadcastBound, lookup
from lexifold.session import materialise

MAX_PARTS = 1000


def document_frequency(counts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Documents per feature; ``counts`` has one row per document and feature."""
    return counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("df"))


def fit_idf(counts: DataFrame, docs: DataFrame, within: str | None = None, path: str | None = None) -> DataFrame:
    """Table ``(feature, df, idf)`` over the documents of ``docs``.

    Documents without any feature count too. ``within`` names a column of both
    inputs, such as the part of a split, inside which everything is counted
    apart; it becomes part of the key.
    """
    keys = [within, "feature"] if within else ["feature"]
    return idf_table(document_frequency(counts, keys), docs, within, path)


def idf_table(df: DataFrame, docs: DataFrame, within: str | None = None, path: str | None = None) -> DataFrame:
    """The same from document frequencies that are already known."""
    total = _part_size(docs, within) if within else docs.agg(F.count(F.lit(1))).scalar()
    return materialise(df.withColumn("idf", T.inverse_weight(total, F.col("df"))), "idf", path)


def fit_idf_running(counts: DataFrame, docs: DataFrame, part: str, order: Sequence[str]) -> DataFrame:
    """Per-part idf whose document frequencies also hold those of earlier parts.

    The number of documents stays that of the part, so weights can be negative.
    """
    so_far = Window.partitionBy("feature").orderBy(_position(part, order))
    df = document_frequency(counts, [part, "feature"]).withColumn("df", F.sum("df").over(so_far))
    return materialise(df.withColumn("idf", T.inverse_weight(_part_size(docs, part), F.col("df"))), "idf")


def _part_size(docs: DataFrame, part: str, max_parts: int = MAX_PARTS) -> Column:
    """Number of documents in the part of the row; a split has few parts."""
    sizes = docs.groupBy(part).agg(F.count(F.lit(1)).alias("n")).limit(max_parts + 1).collect()
    if len(sizes) > max_parts:
        raise ValueError(f"{part} has more than {max_parts} values; it should name the part of a split")
    entries = [F.lit(value) for row in sizes for value in (row[part], row["n"])]
    return F.element_at(F.create_map(*entries), F.col(part)) if entries else F.lit(0)


def _position(column: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))


def apply_idf(
    counts: DataFrame, idf: DataFrame, within: str | None = None, bound: BroadcastBound | None = None
) -> DataFrame:
    """``counts`` with ``df`` and ``weight``; features the table lacks are left out."""
    keys = [within, "feature"] if within else ["feature"]
    joined = lookup(counts, idf, keys, "df", bound=bound)
    return joined.withColumn("weight", T.log_weight(F.col("value")) * F.col("idf"))


def weighted(counts: DataFrame, idf: DataFrame, within: str | None = None) -> DataFrame:
    """Features whose value is the tf-idf weight."""
    return apply_idf(counts, idf, within).withColumn("value", F.col("weight")).drop("df", "idf", "weight")
