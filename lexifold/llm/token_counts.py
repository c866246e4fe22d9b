"""Token counts from the counts of distinct pre-tokens.

A pre-token is a run of characters between ASCII blanks, which the tokeniser never
reaches across. The distinct pre-tokens of all documents are cut into pieces once,
only their number is kept, and it is joined to the frequencies of the pre-tokens in
each document and summed up. No document's ids are ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lexifold.llm.common import empty_if_null, in_pieces, materialise, small_batches
from lexifold.llm.tokens import Encoder
from lexifold.operators.lookup import BroadcastBound, split_table

PIECE_BYTES = 8_000_000


def distinct_words(texts: DataFrame) -> DataFrame:
    """``(word, n)`` for every distinct pre-token of ``texts (text)``, none of which is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 0, PIECE_BYTES):
            words = pc.ascii_split_whitespace(batch.column(0)).flatten().value_counts()
            yield pa.record_batch([words.field("values"), words.field("counts")], ["word", "n"])

    found = texts.select("text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def count_pieces(words: DataFrame, tokenizer: str) -> DataFrame:
    """``words (word, n)`` with the number of ``pieces`` of each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        if encoder.style != "word":
            raise ValueError("this tokeniser keeps white space, so its counts do not add up over words")
        for batch in batches:
            _, begin = encoder.chunks(batch.column(0))
            yield pa.record_batch([*batch.columns, pa.array(np.diff(begin))], ["word", "n", "pieces"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, pieces long")


def sum_frequent(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """``texts`` with ``tokens`` and ``rare`` in place of the last column, ``text``.

    ``tokens`` sums up the pieces of the pre-tokens in ``frequent (word, pieces)``, which is
    broadcast; ``rare`` holds the others as ``array<struct<word, tf>>``.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent.select("word", "pieces").toArrow())
    names = [*texts.columns[:-1], "tokens", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.column("word").combine_chunks()
        pieces = np.append(np.asarray(shared.value.column("pieces")).astype(np.int64), 0)
        for batch in in_pieces(batches, len(names) - 2, PIECE_BYTES):
            parts = pc.ascii_split_whitespace(batch.column(batch.num_columns - 1))
            begin = np.asarray(parts.offsets).astype(np.int64)
            begin = begin - begin[0]
            coded = parts.flatten().dictionary_encode()
            codes, words = np.asarray(coded.indices), coded.dictionary
            place = np.asarray(pc.index_in(words, value_set=known).fill_null(len(known)))
            tokens = np.diff(np.concatenate(([0], np.cumsum(pieces[place][codes])))[begin])
            at = np.flatnonzero((place == len(known))[codes])
            row = np.searchsorted(begin, at, "right") - 1
            pairs, tf = np.unique(row * len(words) + codes[at], return_counts=True)
            row, code = np.divmod(pairs, max(1, len(words)))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            rare = pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(tf, pa.int64())], ["word", "tf"])
            yield pa.record_batch([*batch.columns[:-1], pa.array(tokens), pa.ListArray.from_arrays(ends, rare)], names)

    rare_words = ArrayType(StructType().add("word", "string").add("tf", "long"))
    schema = texts.drop("text").schema.add("tokens", "long").add("rare", rare_words)
    return texts.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, bound: BroadcastBound | None = None) -> DataFrame:
    """One row ``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens. Rows alike in id and text are
    counted together and given back as many times; null ids are kept. An empty table
    gives no rows, other columns are not read. The pre-tokens that occur most often
    are broadcast as far as ``bound`` allows and summed up inside the row; the rare
    ones are joined by shuffle. Texts are read twice, once to count and once to sum.
    """
    text = empty_if_null()
    named = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("text_hash"),
        F.make_valid_utf8(text).alias("text"),
    )
    with small_batches(docs.sparkSession, 2000):
        counted = materialise(count_pieces(distinct_words(named), tokenizer), "piece_counts")
        frequent, rare = split_table(counted, "n", bound or BroadcastBound(400_000, 16 * 1024 * 1024))
        found = sum_frequent(named, frequent)
        found = found.withColumnRenamed("tokens", "n_tokens") if rare is None else _add_rare(found, rare)
        found = materialise(found.select("doc_id", "n_bytes", "n_tokens"), "token_counts")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def _add_rare(found: DataFrame, rare: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` from the rows of :func:`sum_frequent` and the pieces of rare words.

    The first row of a document carries its tokens so far. If it has no rare word, a key
    with a blank, which is no pre-token, takes it through the join.
    """
    none = F.concat(F.lit(" "), F.xxhash64("doc_id", "text_hash").cast("string"))
    document = ["doc_id", "n_bytes", "text_hash"]
    terms = found.select(*document, "tokens", F.posexplode_outer("rare").alias("nth", "term")).select(
        *document,
        F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("tokens")).alias("head"),
        F.coalesce("term.word", none).alias("word"),
        F.coalesce("term.tf", F.lit(0)).alias("tf"),
    )
    joined = terms.join(rare.select("word", "pieces"), "word", "left")
    summed = joined.groupBy(*document).agg(
        F.sum(F.coalesce("head", F.lit(0)) + F.col("tf") * F.coalesce("pieces", F.lit(0))).alias("tokens"),
        F.count("head").alias("rows"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    tokens = (F.col("tokens") / F.col("rows")).cast("long")
    return summed.select("doc_id", "n_bytes", tokens.alias("n_tokens"), each.alias("_"))
