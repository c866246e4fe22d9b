"""Exact duplicates by content-defined chunks.

A text is cut where its content says so, so equal texts give equal chunks. Every
chunk gets an identifier: its 64-bit hash, once it is verified that all chunks of
that hash are alike, or the hash and a variant number where they are not. A
document is then the ordered list of its identifiers, its recipe, and texts are
equal exactly when recipes are. Texts themselves are not moved: the only content
that is shuffled are chunks whose hash occurs more than once, one copy per task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.common import drop_documents, empty_if_null, fresh, join_groups, materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RECIPE = ("recipe", "variants")


@dataclass(frozen=True)
class Chunking:
    """A chunk ends at the first sentence or line end after ``least`` characters, or after ``most``."""

    least: int = 400
    most: int = 4000

    def chunks(self, text: Column) -> Column:
        rule = f"(?s).{{{self.least},{self.most}}}?(?:[.,] |\\n)|.{{1,{self.most}}}"
        return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Letters beyond ASCII stay, so ``lower`` serves only texts where it spares them."""
    beyond = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return F.when(F.lower(beyond) == beyond, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _variants(chunked: DataFrame, repeated: DataFrame) -> DataFrame | None:
    """``(hash, chunk, variant)`` for hashes with several contents, None if there are none."""
    contents = (
        chunked.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c"))
        .select(F.col("c.recipe").alias("hash"), F.col("c.chunks").alias("chunk"))
        .join(repeated, "hash", "left_semi")
        .groupBy("hash", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("hash", "chunk", F.sha2("chunk", 256).alias("digest"), F.octet_length("chunk").alias("bytes"))
    )
    contents = materialise(contents, "chunk_contents")
    clashing = contents.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if clashing.isEmpty():
        return None
    return materialise(
        contents.join(clashing.select("hash"), "hash", "left_semi").select(
            "hash", "chunk", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")).alias("variant")
        ),
        "chunk_variants",
    )


def recipes(
    docs: DataFrame,
    chunking: Chunking | None = None,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """``(doc_id, n_bytes, text_sha256, recipe, variants)`` per row of ``docs``, written.

    ``variants`` is empty unless a chunk shares its hash with another content.
    """
    chunking = chunking or Chunking()
    normal = docs.select("doc_id", ascii_lower(empty_if_null()).alias("normal"))
    chunked = normal.withColumn("chunks", chunking.chunks(F.col("normal"))).withColumn(
        "recipe", F.transform("chunks", lambda c: chunk_hash(c))
    )
    listed = materialise(
        chunked.select(
            "doc_id", F.octet_length("normal").cast("long").alias("n_bytes"), F.sha2("normal", 256).alias("text_sha256"), "recipe"
        ),
        "recipes",
    )
    repeated = materialise(
        listed.select(F.explode("recipe").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "repeated_chunks",
    ).select("hash")
    hint = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    variants = _variants(chunked, hint)
    none = F.expr("cast(array() as array<struct<position:int,variant:int>>)")
    if variants is None:
        return listed.withColumn("variants", none)
    keys = ["doc_id", "text_sha256", "n_bytes"]
    found = (
        chunked.select(
            "doc_id", F.sha2("normal", 256).alias("text_sha256"), F.octet_length("normal").cast("long").alias("n_bytes"),
            F.posexplode(F.arrays_zip("recipe", "chunks")).alias("position", "c"),
        )
        .select(*keys, "position", F.col("c.recipe").alias("hash"), F.col("c.chunks").alias("chunk"))
        .join(variants, ["hash", "chunk"])
        .groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("null")).alias(f"_{k}") for k in keys])
        .agg(F.sort_array(F.collect_set(F.struct("position", "variant"))).alias("variants"))
    )
    same = [F.coalesce(F.col(k).cast("string"), F.lit("null")) == F.col(f"_{k}") for k in keys]
    joined = listed.join(found, same[0] & same[1] & same[2], "left").drop(*[f"_{k}" for k in keys])
    return materialise(joined.withColumn("variants", F.coalesce("variants", none)), "verified_recipes")


def exact_duplicates(
    docs: DataFrame, chunking: Chunking | None = None, chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row ``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null is the empty text.
    The row with the largest id stays. A null id is less than any other; of rows
    that repeat this very id and text, one stays. An empty table gives no rows.
    Other columns are not read.
    """
    listed = recipes(docs, chunking, chunk_hash)
    groups = materialise(
        listed.groupBy(*RECIPE).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "recipe_groups",
    )
    size = F.size("recipe") * 8 + F.size("variants") * 16 + 80
    joined = join_groups(listed, groups, RECIPE, "group_size", salt_by="doc_id", row_bytes=size)
    largest = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = joined.select("doc_id", "keep_id", "group_size", largest.alias("kept"), "text_sha256")
    if listed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return marked
    again = Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")
    return marked.withColumn("kept", F.col("kept") & (F.row_number().over(again) == 1))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    marked = materialise(exact_duplicates(docs), "exact_duplicates")
    named = marked.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"))
    if marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return drop_documents(docs, materialise(marked.filter("not kept").select("doc_id"), "exact_dropped"))
    gone = materialise(named.filter("not kept"), "exact_dropped")
    digest, number = fresh(docs, "_digest"), fresh(docs, "_number")
    told = docs.withColumn(digest, F.sha2(ascii_lower(empty_if_null()), 256))
    left = told.join(
        gone.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")),
        F.col("_id").eqNullSafe(told["doc_id"]) & (F.col("_sha") == told[digest]),
        "left_anti",
    )
    once = left.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(F.lit(1))))
    return once.filter(F.col(number) == 1).drop(digest, number)
