"""Features from hierarchical word clusters.

A cluster is named by its path from the root, a string of 0 and 1. Every prefix
of the path of a word is a feature of the documents that hold the word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.operators.lookup import BroadcastBound, rarer, split_table
from lexifold.operators.terms import explode_terms
from lexifold.session import materialise

# A word counts as hot from this share of the documents of the most frequent
# word on, and from this number of documents on.
HOT_SHARE = 1e-4
HOT_LEAST = 1000


def cluster_bridge(
    paths: DataFrame,
    vocab: DataFrame,
    cutoff: int = 0,
    leaf_only: bool = False,
    path: str | None = None,
) -> DataFrame:
    """Table ``(token, path, skip, df)`` that leads from words to clusters.

    Only words of the vocabulary are kept. The features of a row are the
    prefixes of ``path`` longer than ``skip``: the ``cutoff`` shortest ones are
    left out, and so are those that another path of the same word already has.
    As the paths of a word are ordered, those are the ones shared with the path
    before. With ``leaf_only`` the whole path is the only feature.

    Lines are made distinct before they meet in a task, so a word has at most as
    many rows as there are clusters, however often the file repeats it. Frequent
    words without a cluster get a row without a path, so that a lookup beyond the
    broadcast bound knows them and does not shuffle their many occurrences for
    nothing. ``vocab`` must be a written table.
    """
    listed = paths.select(F.col("word").alias("token"), "path").distinct()
    known = listed.join(vocab.select("token", "df"), "token")
    previous = F.lag("path").over(Window.partitionBy("token").orderBy("path"))
    bridge = known.withColumn("previous", previous)
    if leaf_only:
        bridge = bridge.withColumn("skip", F.length("path") - 1)
    else:
        shared = T.common_prefix_length(F.col("previous"), F.col("path"))
        bridge = bridge.withColumn("skip", F.greatest(F.lit(cutoff), shared))
        bridge = bridge.filter(F.length("path") > F.col("skip"))
    bridge = bridge.select("token", "path", "skip", "df")
    least = F.greatest(vocab.agg(F.max("df")).scalar() * HOT_SHARE, F.lit(HOT_LEAST))
    hot = vocab.filter(F.col("df") >= least).join(listed.select("token"), "token", "left_anti")
    without = hot.select("token", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("skip"), "df")
    return materialise(bridge.unionByName(without), "bridge", path)


def _explode_prefixes(df: DataFrame, keep: Sequence[str], out: str) -> DataFrame:
    """One row per prefix of ``path`` longer than ``skip``.

    Exploding the lengths and cutting afterwards stays in generated code, which
    a function over an array of prefixes would not.
    """
    lengths = F.sequence(F.col("skip") + 1, F.length("path"))
    return df.select(*keep, "path", F.explode_outer(lengths).alias("__length")).select(
        *keep, F.substring("path", F.lit(1), F.col("__length")).alias(out)
    )


def bridge_prefixes(bridge: DataFrame) -> DataFrame:
    """The bridge written out: one row per word and feature."""
    clustered = bridge.filter(F.col("path").isNotNull()).withColumnRenamed("token", "word")
    return _explode_prefixes(clustered, ["word"], "prefix")


def cluster_counts(
    inst: DataFrame,
    bridge: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    bucketed: bool = False,
    bound: BroadcastBound | None = None,
) -> DataFrame:
    """Cluster features with counts: the sum over the words below the cluster.

    The compact instances are distributed by document first. Counting by leaf
    and then by prefix needs no further shuffle, and the prefixes, which are
    many more bytes than the instances, are never moved. ``bucketed`` says that
    the instances come from a table bucketed by document, so that nothing at all
    has to be moved. If the bridge is beyond the broadcast bound, occurrences of its
    rare words are joined first, and distributed along with the instances.
    """
    rows = inst.select(*keep, "terms")
    frequent, rare = split_table(bridge, "df", bound)
    if rare is None:
        spread = explode_terms(rows if bucketed else rows.repartition(*keep), keep)
        found = spread.join(F.broadcast(frequent), ["token"]).filter(F.col("path").isNotNull())
    else:
        far = rarer(explode_terms(rows, keep), frequent, ["token"]).join(rare, "token").filter(F.col("path").isNotNull())
        leaf = F.struct("path", "skip", "tf")
        far = far.select(*keep, F.lit(None).cast(inst.schema["terms"].dataType).alias("terms"), leaf.alias("leaf"))
        both = rows.withColumn("leaf", F.lit(None).cast(far.schema["leaf"].dataType)).unionByName(far)
        spread = both.repartition(*keep).select(*keep, "leaf", F.inline_outer("terms"))
        known = spread.join(F.broadcast(frequent.select("token", "path", "skip")), ["token"], "left")
        found = known.select(*keep, *[F.coalesce(f"leaf.{c}", c).alias(c) for c in ("path", "skip", "tf")])
        found = found.filter(F.col("path").isNotNull())
    leaves = found.groupBy(*keep, "path", "skip").agg(F.sum("tf").alias("tf"))
    return (
        _explode_prefixes(leaves, [*keep, "tf"], "feature")
        .groupBy(*keep, "feature")
        .agg(F.sum("tf").alias("value"))
        .select(*keep, F.lit("brown").alias("family"), "feature", "value")
    )
