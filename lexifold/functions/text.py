"""Text expressions, all evaluated in the JVM on one row at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of the tokenisers.
PUNCTUATION_OR_DIGIT = r"[!-@\[-`{-~]"
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"
PUNCTUATION_DIGIT_OR_SPACE = r"[!-@\[-`{-~ \t\n\x0B\f\r]+"
UNICODE_SPACE_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
UNICODE_SPACE = "[" + UNICODE_SPACE_CHARS + "]+"
QUOTES = "[«»“”‘’„]"

# The contractions that hold no apostrophe, cut in two.
CONTRACTIONS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))

EMPTY_TERMS = "cast(array() as array<struct<token:string,tf:bigint>>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def clean_text(text: Column) -> Column:
    """Punctuation and digits become blanks, the rest is lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION_OR_DIGIT, " "))


def whitespace_tokens(text: Column, unicode_space: bool = False) -> Column:
    """Maximal runs of non-blank characters, in order."""
    pattern = UNICODE_SPACE if unicode_space else ASCII_SPACE
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def clean_tokens(text: Column) -> Column:
    """``whitespace_tokens(clean_text(text))`` in one pass over the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, PUNCTUATION_DIGIT_OR_SPACE), "")


def split_contractions(text: Column) -> Column:
    """Cut the six contractions in two wherever they stand as whole words.

    ``wanna`` is cut only before a blank or the end of the text.
    """
    heads = []
    for left, right in CONTRACTIONS:
        end = r"(?=\s|$)" if left == "wan" else r"(?![\p{L}\p{N}_])"
        heads.append(f"({left})({right}){end}")
    pattern = r"(?<![\p{L}\p{N}_])(?:" + "|".join(heads) + ")"
    groups = range(1, 2 * len(CONTRACTIONS), 2)
    left = "".join(f"${g}" for g in groups)
    right = "".join(f"${g + 1}" for g in groups)
    return F.regexp_replace(text, pattern, f" {left} {right} ")


def word_tokens(cleaned: Column, split_quotes: bool = False) -> Column:
    """Word tokens of cleaned text: contractions cut, then split on blanks.

    ``split_quotes`` also makes every typographic quote a token of its own.
    """
    text = split_contractions(cleaned)
    if split_quotes:
        text = F.regexp_replace(text, f"({QUOTES})", " $1 ")
    return whitespace_tokens(text, unicode_space=True)


def sentences(text: Column) -> Column:
    """Cut after a run of ``.``, ``!`` or ``?`` that blanks follow."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(UNICODE_SPACE_CHARS))
    return F.split(trimmed, r"(?<=[.!?])[ \t\n\x0B\f\r]+")


def remove_stopwords(tokens: Column, stopwords: Sequence[str], case_sensitive: bool = False) -> Column:
    """Drop the listed words; by default their case does not matter."""
    if not stopwords:
        return tokens
    if case_sensitive:
        return F.filter(tokens, lambda t: ~t.isin(list(stopwords)))
    lowered = sorted({word.lower() for word in stopwords})
    return F.filter(tokens, lambda t: ~F.lower(t).isin(lowered))


def term_counts(tokens: Column) -> Column:
    """``array<struct<token, tf>>`` of the tokens of one row, ordered by token.

    The tokens are sorted and the lengths of equal runs are read off, so the
    counts of a document need neither an explode nor a shuffle.
    """

    def counted(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda first: F.transform(
                first,
                lambda at, i: F.struct(
                    F.get(ordered, at).alias("token"),
                    (F.coalesce(F.get(first, i + 1), size) - at).cast("bigint").alias("tf"),
                ),
            ),
        )

    return let(
        F.sort_array(tokens),
        lambda ordered: F.when(F.size(ordered) == 0, F.expr(EMPTY_TERMS)).otherwise(counted(ordered)),
    )


def term_list(terms: Column) -> Column:
    """A document as its distinct tokens in token order, blank separated."""
    return F.array_join(F.transform(terms, lambda t: t["token"]), " ")


def common_prefix_length(left: Column, right: Column) -> Column:
    """Number of leading characters that both strings share (0 for null)."""
    shortest = F.least(F.length(left), F.length(right))
    return F.when(
        shortest > 0,
        F.size(
            F.filter(
                F.sequence(F.lit(1), shortest),
                lambda i: F.substring(left, F.lit(1), i) == F.substring(right, F.lit(1), i),
            )
        ),
    ).otherwise(F.lit(0))


def log_weight(tf: Column) -> Column:
    """``1 + log10(tf)``."""
    return F.lit(1.0) + F.log10(tf)


def inverse_weight(n_docs: Column, df: Column) -> Column:
    """``log10(n / df)``, without smoothing."""
    return F.log10(n_docs / df)


def presence(count: Column) -> Column:
    """1 for a positive count, else 0."""
    return F.when(count > 0, F.lit(1)).otherwise(F.lit(0))


def parse_label(label: Column) -> Column:
    """The label as a double; null where it does not parse."""
    return F.trim(label).try_cast("double")
