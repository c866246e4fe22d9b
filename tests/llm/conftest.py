import pytest

LONG = " ".join(f"word{i % 701}x{i % 13}" for i in range(20_000))
CLASH = ("fp", "score", "lang_pred", "predicted", "shard", "part", "size", "text_hash", "words", "key", "keep_id", "_text", "host", "_gone", "n")

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog. Again and again it jumps.", "en", "s0"),
    (2, "the QUICK brown fox jumps over the lazy dog. again and again it jumps.", "en", "s0"),
    (3, None, "en", "s0"),
    (4, "", None, "s0"),
    (5, "", "en", None),
    (None, "a row without an id", "en", "s1"),
    (None, None, None, None),
    (7, "12345 ... !!!", "de", "s1"),
    (8, LONG, "en", "s1"),
    (9, LONG + " end", "en", "s1"),
    (10, "same row", "fr", "s2"),
    (10, "same row", "fr", "s2"),
    (11, "É ÀÉÎ straße ЖЖЖ 東京   x\x1cy <|endoftext|> z", "fr", "s2"),
    (12, "é àéî straße ЖЖЖ 東京   x\x1cy <|endoftext|> z", "fr", "s2"),
    (13, "  two  blanks\n\n and \t tabs \n", "es", "s2"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, long and repeated rows, and columns named like those the operators make."""
    rows = [(*r, len(r[1] or ""), *[f"own {c}" for c in CLASH]) for r in EDGE]
    columns = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
