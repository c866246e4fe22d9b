"""Documents as term counts, the vocabulary, and bag-of-words features.

Two table shapes are used throughout. *Instances* hold one row per document:
``(doc_id, …, terms array<struct<token, tf>>)``. *Features* hold one row per
document and feature: ``(doc_id, family, feature, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions import text as T


def tokenize(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    clean: bool = True,
    stopwords: Sequence[str] = (),
) -> DataFrame:
    """``keep`` columns plus the tokens of each document in order."""
    tokens = T.clean_tokens(F.col(text)) if clean else T.whitespace_tokens(F.col(text))
    tokens = T.remove_stopwords(tokens, stopwords)
    return docs.select(*keep, tokens.alias("tokens"))


def instances(tokenized: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Replace the tokens of each document by their counts, within the row.

    Documents without tokens keep a row with an empty array.
    """
    others = [c for c in tokenized.columns if c != tokens]
    return tokenized.select(*others, T.term_counts(F.col(tokens)).alias("terms"))


def explode_terms(inst: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document and distinct token.

    The outer generator keeps Spark from testing the array for emptiness first,
    which would compute the counts a second time.
    """
    return inst.select(*keep, F.inline_outer("terms")).filter(F.col("token").isNotNull())


def vocabulary(inst: DataFrame) -> DataFrame:
    """Distinct tokens with document frequency and total count."""
    return (
        explode_terms(inst, keep=())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    )


def bow_counts(inst: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Bag-of-words features with counts."""
    return explode_terms(inst, keep).select(
        *keep, F.lit("bow").alias("family"), F.col("token").alias("feature"), F.col("tf").alias("value")
    )


def bow_binary(inst: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Bag-of-words features with presence 1."""
    return bow_counts(inst, keep).withColumn("value", T.presence(F.col("value")).cast("bigint"))


def union_once(train: DataFrame, test: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents of both sets, each once: a test document that is also in train is left out."""
    return train.unionByName(test.join(train.select(key), key, "left_anti"))


def corpus_stats(train: DataFrame, test: DataFrame) -> DataFrame:
    """Documents and vocabulary size of the training set, the test set and both."""
    tagged = train.select(F.lit("train").alias("part"), "doc_id", "terms").unionByName(
        test.select(F.lit("test").alias("part"), "doc_id", "terms")
    )
    words = (
        tagged.select("part", F.inline_outer("terms"))
        .filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(
            F.max(F.when(F.col("part") == "train", 1).otherwise(0)).alias("in_train"),
            F.max(F.when(F.col("part") == "test", 1).otherwise(0)).alias("in_test"),
        )
        .agg(
            F.coalesce(F.sum("in_train"), F.lit(0)).cast("bigint").alias("train"),
            F.coalesce(F.sum("in_test"), F.lit(0)).cast("bigint").alias("test"),
            F.count(F.lit(1)).alias("both"),
        )
        .unpivot([], ["train", "test", "both"], "part", "n_words")
    )
    docs = tagged.agg(
        F.count(_when("train")).alias("train"),
        F.count(_when("test")).alias("test"),
        F.count(F.lit(1)).alias("both"),
    ).unpivot([], ["train", "test", "both"], "part", "n_docs")
    return docs.join(words, "part")


def _when(part: str) -> Column:
    return F.when(F.col("part") == part, 1)
