"""Review files, labelled text lines, sentence files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions import text as T

# Fixed value: layout of a labelled line, as name, label and text.
LABELLED_LINE = r"(?s)^(\S*)[\s,]*(\S*)[\s,]*(.*)$"
CORRUPT = "_corrupt_record"


def review_schema(key: str | None = None) -> str:
    """Read schema with the review text and, if named, a key field."""
    return (f"`{key}` string, " if key else "") + f"reviewText string, {CORRUPT} string"


def read_reviews(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """JSON lines as ``(doc_id, reviewText, _corrupt_record)``; other fields are not read.

    ``key`` names a field that identifies the review. Without one the rows get
    numbers that are unique but not consecutive; write the table before it is
    used twice.
    """
    rows = spark.read.schema(review_schema(key)).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    doc_id = F.col(key) if key else F.monotonically_increasing_id()
    return rows.select(doc_id.alias("doc_id"), "reviewText", CORRUPT)


def parse_reviews(df: DataFrame, value: str = "value") -> DataFrame:
    """The same for JSON in a string column; other columns are kept."""
    parsed = F.from_json(
        value, review_schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    others = [c for c in df.columns if c != value]
    return df.withColumn("__parsed", parsed).select(*others, "__parsed.reviewText", f"__parsed.{CORRUPT}")


def good_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with a text."""
    return reviews.filter(F.col("reviewText").isNotNull()).drop(CORRUPT)


def bad_reviews(reviews: DataFrame) -> DataFrame:
    """Quarantine: malformed lines and reviews without a text."""
    return reviews.filter(F.col("reviewText").isNull())


def parse_labelled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines as ``(name, label, data)``; blank lines are skipped.

    A comma right after the name belongs to it, as the name is the longest run
    without blanks.
    """
    line = F.col(value)
    return lines.filter(F.trim(line) != "").select(
        *[
            F.regexp_extract(line, LABELLED_LINE, group).alias(name)
            for group, name in ((1, "name"), (2, "label"), (3, "data"))
        ]
    )


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """Labelled lines from a text file."""
    return parse_labelled_lines(spark.read.text(path))


def with_numeric_label(df: DataFrame, label: str = "label", strict: bool = True) -> DataFrame:
    """The label as a double. ``strict`` fails on a bad one, else it becomes null."""
    if strict:
        return df.withColumn(label, F.trim(F.col(label)).cast("double"))
    return df.withColumn(label, T.parse_label(F.col(label)))


def good_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label parses, with the label as a double."""
    return with_numeric_label(df, label, strict=False).filter(F.col(label).isNotNull())


def bad_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label does not parse."""
    return df.filter(T.parse_label(F.col(label)).isNull())


def document_name(category: Column, prefix: str, number: Column) -> Column:
    """Name of a document from its category, a prefix and a number or key."""
    return F.concat(category, F.lit(prefix), number.cast("string"))


def labelled_corpus(
    docs: DataFrame, category: Column, prefix: str = "", text: str = "text", split_quotes: bool = False
) -> DataFrame:
    """Cleaned documents as ``(doc_id, name, label, data)``.

    The sentences are not told apart: cutting them would not change the tokens.
    """
    tokens = T.word_tokens(T.clean_text(F.col(text)), split_quotes)
    return docs.select(
        "doc_id",
        document_name(category, prefix, F.col("doc_id")).alias("name"),
        category.cast("string").alias("label"),
        F.array_join(tokens, " ").alias("data"),
    )


def render_labelled_lines(corpus: DataFrame) -> DataFrame:
    """One text line per document."""
    return corpus.select(F.concat_ws(" ", "name", "label", "data").alias("value"))


def write_labelled_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Labelled lines to text files."""
    render_labelled_lines(corpus).write.mode(mode).text(path)


def sentence_corpus(docs: DataFrame, text: str = "text", split_quotes: bool = False) -> DataFrame:
    """One row per sentence as ``(doc_id, sentence_no, sentence)``, cleaned.

    A sentence without tokens keeps its row.
    """
    cut = docs.select("doc_id", F.posexplode_outer(T.sentences(F.col(text))).alias("sentence_no", "raw"))
    tokens = T.word_tokens(T.clean_text(F.col("raw")), split_quotes)
    return cut.select("doc_id", "sentence_no", F.array_join(tokens, " ").alias("sentence"))


def write_sentence_corpus(sentences: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One sentence per line, without document or label."""
    sentences.select("sentence").write.mode(mode).text(path)
