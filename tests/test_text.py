import string
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexifold.functions import text as T


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("v")).first()["v"]


def test_cleaning_replaces_exactly_ascii_punctuation_and_digits(spark):
    text = "".join(chr(c) for c in range(32, 127)) + "ÀÉñ“”€²"
    expected = "".join(" " if c in string.punctuation + string.digits else c.lower() for c in text)
    assert one(spark, text, T.clean_text) == expected


def test_null_text_is_empty(spark):
    assert one(spark, None, T.clean_text) == ""
    assert one(spark, None, T.whitespace_tokens) == []


def test_lower_case_of_final_sigma_and_dotted_i(spark):
    assert one(spark, "ΟΔΟΣ", T.clean_text) in ("οδος", "οδοσ")
    assert one(spark, "İ", T.clean_text).startswith("i")


def test_whitespace_tokens_keep_non_ascii_blanks_unless_asked(spark):
    text = " a\tb\x0bc d e f "
    assert one(spark, text, T.whitespace_tokens) == ["a", "b", "c", "d e f"]
    assert one(spark, text, lambda c: T.whitespace_tokens(c, unicode_space=True)) == list("abcdef")


def test_contractions(spark):
    text = "cannot cannot Gimme gonna xgonna gottas lemme wanna “cannot” wanna” é‿wanna écannot"
    assert one(spark, text.lower(), T.word_tokens) == (
        "can not can not gim me gon na xgonna gottas lem me wan na “ can not ” wanna” é‿ wan na écannot".split()
    )


def test_quotes_are_split_on_request(spark):
    assert one(spark, "«oui» “yes”", lambda c: T.word_tokens(c, split_quotes=True)) == ["«", "oui", "»", "“", "yes", "”"]
    assert one(spark, "«oui» “yes”", T.word_tokens) == ["«oui»", "“yes”"]


def test_sentences(spark):
    text = "\n One two.  Three?!\nFour... five 3.5 six! "
    assert one(spark, text, T.sentences) == ["One two.", "Three?!", "Four...", "five 3.5 six!"]
    assert one(spark, "", T.sentences) == [""]


def test_stopwords(spark):
    def removed(**options):
        return lambda c: T.remove_stopwords(T.whitespace_tokens(c), ["The", "of"], **options)

    assert one(spark, "the cat of THE hat", removed()) == ["cat", "hat"]
    assert one(spark, "the cat of The hat", removed(case_sensitive=True)) == ["the", "cat", "hat"]
    assert one(spark, "the cat", lambda c: T.remove_stopwords(T.whitespace_tokens(c), [])) == ["the", "cat"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "zz", "Z", "-"]), max_size=12), min_size=1, max_size=30))
def test_term_counts_equal_a_counter(spark, documents):
    rows = [(i, tokens) for i, tokens in enumerate(documents)]
    df = spark.createDataFrame(rows, "i bigint, tokens array<string>")
    for row in df.select("i", T.term_counts(F.col("tokens")).alias("terms")).collect():
        counts = Counter(documents[row["i"]])
        assert {t["token"]: t["tf"] for t in row["terms"]} == dict(counts)
        assert [t["token"] for t in row["terms"]] == sorted(counts, key=lambda w: w.encode())


def test_clean_tokens_are_the_tokens_of_clean_text(spark):
    for text in ("A-b, c3d \u00c9t\u00e9\x0b\u2126 \u212a1", "", None, "  42 ", "x" * 50 + "!", "\u00a0a\u00a0"):
        two_steps = one(spark, text, lambda c: T.whitespace_tokens(T.clean_text(c)))
        assert one(spark, text, T.clean_tokens) == two_steps


def test_common_prefix_length(spark):
    def shared(left, right):
        return spark.range(1).select(T.common_prefix_length(F.lit(left).cast("string"), F.lit(right))).first()[0]

    assert [shared("0110", "0101"), shared("01", "0111"), shared("1", "0"), shared("", "0"), shared(None, "0")] == [
        2,
        2,
        0,
        0,
        0,
    ]


def test_labels(spark):
    assert one(spark, " 2.0 ", T.parse_label) == 2.0
    assert one(spark, "cat", T.parse_label) is None


def test_weights(spark):
    row = spark.range(1).select(
        T.log_weight(F.lit(100)), T.inverse_weight(F.lit(10), F.lit(10)), T.presence(F.lit(0)), T.presence(F.lit(3))
    ).first()
    assert tuple(row) == (3.0, 0.0, 0, 1)
