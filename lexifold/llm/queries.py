"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.llm import (
    decontaminate,
    exact_dedup,
    html_main,
    language_id,
    near_dedup,
    packing,
    resample,
    sharding,
    token_codes,
    token_counts,
    toxicity,
    vector_codes,
    vector_dedup,
)
from lexifold.llm.common import held_out, read_table, scratch_path
from lexifold.llm.tokens import public_path


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    model = toxicity.fit_toxicity(docs, read_table(spark, sf, "labels"))
    scored = toxicity.score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_pack(spark: SparkSession, sf: str) -> DataFrame:
    pieces, _ = packing.pack(_docs(spark, sf), public_path("byte_bpe_50k.json"), end_id=1)
    return pieces.drop("key")


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf), public_path("word_bpe_49k.json"), limit=2048)


def op4_token_codes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token_codes")
    token_codes.write_codes(_docs(spark, sf), path, public_path("word_bpe_49k.json"), end_id=2)
    return token_codes.read_documents(spark, path)


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    model = language_id.fit_languages(docs, public_path("piece_bpe_32k.model"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contaminated(_docs(spark, sf), read_table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "window_words", F.round("similarity", 6).alias("similarity"))


def op7_shard(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(_docs(spark, sf), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_html_main(spark: SparkSession, sf: str) -> DataFrame:
    return html_main.extract_pages(read_table(spark, sf, "pages"))


def op9_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf), words=3, threshold=2)


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf))


def op11_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = vector_dedup.near_duplicate_vectors(read_table(spark, sf, "embeddings"))
    return found


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(read_table(spark, sf, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(vector_codes.books_digest(books)))


def op13_resample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resample(_docs(spark, sf), read_table(spark, sf, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_pack,
        op3_token_counts,
        op4_token_codes,
        op5_language_id,
        op6_decontaminate,
        op7_shard,
        op8_html_main,
        op9_near_dedup,
        op10_exact_dedup,
        op11_vector_dedup,
        op12_vector_codes,
        op13_resample,
    )
}
