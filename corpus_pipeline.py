"""From raw documents to a clean corpus in packed sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexifold.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from lexifold.llm.common import materialise, read_table
from lexifold.llm.tokens import public_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty, or without a letter."""
    model = language_id.fit_languages(docs, public_path("piece_bpe_32k.model"))
    return language_id.keep_identified(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_one_of_each(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints the one with the least id stays."""
    return near_dedup.keep_one_of_each(docs, words=3, threshold=2)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token of the documents goes in windows of 2,048."""
    pieces, _ = packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=1)
    return pieces.drop("key")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", pack_stage),
]

# Trained language models and tokenisers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each is written, and the next reads the files."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
