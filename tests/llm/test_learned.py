"""Language and toxicity: brute-force sums, held-out accuracy, edge rows."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexifold.llm import language_id, toxicity
from lexifold.llm.common import held_out, learnable
from lexifold.llm.tokens import public_path

from .conftest import EDGE, LONG

PIECES = public_path("piece_bpe_32k.model")
SYLLABLES = {"en": ["the", "ing", "er", "on"], "de": ["sch", "ung", "ein", "keit"], "fr": ["eau", "que", "oi", "ment"]}


def words_of(lang, seed, n=60):
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(SYLLABLES[lang], random.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, words_of(lang, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(spoken):
    return language_id.fit_languages(spoken, PIECES)


def brute_word(word, texts, probabilities, longest):
    """Sum over all segmentations by recursion."""
    line = language_id.WORD_START + word

    def rest(at):
        if at == len(line):
            return 1.0
        total = 0.0
        for size in range(1, min(longest, len(line) - at) + 1):
            number = texts.get(line[at : at + size], texts[None] if size == 1 else None)
            if number is not None:
                total += probabilities[number] * rest(at + size)
        return total

    return math.log(rest(0))


def piece_numbers(model):
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    numbers = {None: len(model.pieces) - 1}
    for i in range(vocabulary.get_piece_size()):
        piece = vocabulary.id_to_piece(i)
        if piece and not (vocabulary.is_byte(i) or vocabulary.is_control(i) or vocabulary.is_unknown(i)):
            numbers[piece] = int(model.pieces.find(np.array([language_id._hash(piece)], np.uint64))[0])
    return numbers


def test_forward_sums_all_segmentations(model):
    numbers = piece_numbers(model)
    assert model.pieces.longest == max(map(len, filter(None, numbers)))
    words = ["the", "thering", "schung", "x", "été", "東京", "qzqzq", "a", "internationalization"]
    found = language_id.forward(words, model.pieces, model.probabilities)
    for row, word in zip(found, words, strict=True):
        for column in range(len(model.languages)):
            assert row[column] == pytest.approx(brute_word(word, numbers, model.probabilities[:, column], model.pieces.longest))


def sum_in_order(line, numbers, probabilities, longest):
    """Log of the sum over all segmentations, in exact fractions of the probabilities as they are."""
    sums = [Fraction(1)]
    for end in range(1, len(line) + 1):
        total = Fraction(0)
        for size in range(1, min(longest, end) + 1):
            number = numbers.get(line[end - size : end], numbers[None] if size == 1 else None)
            if number is not None:
                total += sums[end - size] * Fraction(probabilities[number])
        sums.append(total)
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_words_of_any_length_are_summed_whole(model):
    numbers = piece_numbers(model)
    words = ["internationalization" * k for k in (1, 2, 3, 7)] + ["schungkeit" * 12, "東京x" * 10]
    found = language_id.forward(words, model.pieces, model.probabilities)
    logs = np.log(model.probabilities)
    for row, word in zip(found, words, strict=True):
        line = language_id.WORD_START + word
        for column in range(len(model.languages)):
            assert row[column] == pytest.approx(sum_in_order(line, numbers, model.probabilities[:, column], model.pieces.longest), rel=1e-9)
        chars = np.array([[ord(c) + 1 for c in line]], np.uint64)
        for block in (1, 7, 50, 4000):
            assert np.allclose(language_id._log_total(chars, model.pieces, logs, block)[0], row, rtol=1e-10)


def test_a_word_of_a_hundred_thousand_letters_has_a_finite_sum(model):
    found = language_id.forward(["keit" * 25_000], model.pieces, model.probabilities)
    assert np.isfinite(found).all() and model.languages[int(found[0].argmax())] == "de"


def test_whole_texts_against_brute_force(spark, spoken, model):
    numbers = piece_numbers(model)
    texts = [r["text"] for r in spoken.filter(held_out()).limit(6).collect()] + ["Ding, schung; internationalizationing " + "eau" * 15, "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_id.identify(rows, model).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", text.lower())
        totals = [
            sum(sum_in_order(language_id.WORD_START + w, numbers, model.probabilities[:, c], model.pieces.longest) for w in words)
            for c in range(len(model.languages))
        ]
        scaled = [(t - max(totals)) * min(1, model.settings.evidence / len(words)) for t in totals]
        assert found[i]["lang_pred"] == model.languages[int(np.argmax(totals))]
        assert found[i]["score"] == pytest.approx(1 / sum(map(math.exp, scaled)))


def test_counts_of_long_words_agree_with_those_of_short_ones(model, monkeypatch):
    words = ["thering", "schungkeit", "eauque"]
    weights = np.arange(1.0, 1 + 3 * len(model.languages)).reshape(3, -1)
    plain = language_id.expected_counts(words, weights, model.pieces, model.probabilities)
    monkeypatch.setattr(language_id, "PLAIN_CHARS", 0)
    assert np.allclose(language_id.expected_counts(words, weights, model.pieces, model.probabilities), plain)


def test_the_sample_is_bounded_for_every_language(spark):
    rows = [(i, f"w{'abcdefghij'[i % 10]}{'x' * (i % 50)}", "en" if i % 8 else "de") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = language_id.LanguageSettings(docs_per_language=100)
    counts = {r["lang"]: r["n"] for r in language_id.sample_words(docs, small).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"en": 100, "de": 100}


def test_expected_counts_add_up_to_the_characters(model):
    words = ["thering", "schung"]
    counts = language_id.expected_counts(words, np.ones((2, len(model.languages))), model.pieces, model.probabilities)
    assert (counts.sum(axis=0) >= 2).all() and (counts.sum(axis=0) <= len("thering") + len("schung") + 2 + 1e-9).all()


def test_language_of_held_out_texts(spoken, model):
    found = language_id.identify(spoken, model).filter(held_out()).collect()
    assert len(found) > 10 and all(r["lang"] == r["lang_pred"] for r in found)
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.probabilities.sum(axis=0), 1)


def test_language_edge_rows(edge, nothing, model):
    found = language_id.identify(edge.drop("score", "lang_pred"), model).collect()
    assert len(found) == len(EDGE)
    for r in found:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["lang_pred"] != "und")
    clash = language_id.identify(edge, model)
    assert clash.columns == [*edge.columns, "lang_pred_", "score_"] and clash.first()["score"] == "own score"
    assert language_id.identify(nothing, model).count() == 0
    kept = language_id.keep_identified(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in EDGE)
    untaught = language_id.fit_languages(nothing, PIECES)
    assert {r["lang_pred"] for r in language_id.identify(edge.select("doc_id", "text"), untaught).collect()} == {"und"}


def test_labels_come_only_from_learnable_rows(spark, spoken, model):
    swapped = spoken.withColumn("lang", F.when(learnable(), F.col("lang")).otherwise("xx"))
    other = language_id.fit_languages(swapped, PIECES)
    assert other.languages == model.languages and np.allclose(other.probabilities, model.probabilities)
    assert spark.range(1).select(learnable("id"), held_out("id")).first()[0] != spark.range(1).select(held_out("id")).first()[0]


# ---- toxicity -------------------------------------------------------------------

BAD = ["blockhead", "rubbish", "nitwit", "garbage"]


@pytest.fixture(scope="module")
def labelled(spark):
    random = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(400):
        words = words_of("en" if i % 2 else "de", 1000 + i, 80).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(int(random.integers(len(words))), str(random.choice(BAD)))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def judge(labelled):
    return toxicity.fit_toxicity(*labelled)


def test_toxicity_of_held_out_texts(labelled, judge):
    docs, labels = labelled
    found = toxicity.score_texts(docs, judge).join(labels, "doc_id").filter(held_out()).collect()
    right = sum(r["predicted"] == r["toxic"] for r in found)
    assert len(found) > 50 and right >= 0.97 * len(found)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in found)


def test_a_bad_word_anywhere_in_a_long_text_is_found(spark, judge):
    plain = words_of("en", 5, 6000)
    rows = spark.createDataFrame([(1, plain), (2, f"{plain} nitwit garbage rubbish")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(rows, judge).collect()}
    assert scores[2] > scores[1]


def test_margins_favour_bad_words(judge):
    margins = toxicity.Margins(judge.toxic, judge.ordinary, judge.settings)
    assert min(margins.of_word(w.encode()) for w in BAD) >= 2 > margins.of_word(b"schung")
    assert margins.of_word(b"x" * 500 + b"nitwit") >= margins.of_word(b"x")


def test_toxicity_edge_rows(edge, nothing, labelled, judge):
    found = toxicity.score_texts(edge.select("doc_id", "text"), judge).collect()
    assert len(found) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in found)
    assert len({r["score"] for r in found if not (r["text"] or "").strip()}) == 1
    clash = toxicity.score_texts(edge, judge)
    assert clash.columns == [*edge.columns, "score_", "predicted_"] and clash.count() == len(EDGE)
    assert toxicity.score_texts(nothing, judge).count() == 0
    untaught = toxicity.fit_toxicity(nothing, labelled[1].limit(0))
    assert {r["score"] < 1e-9 for r in toxicity.score_texts(edge.select("text"), untaught).collect()} == {True}


def test_long_text_is_read_to_its_end():
    windows = toxicity._windows(LONG, toxicity.ToxicitySettings())
    assert len(windows) == 20_000


def test_texts_with_letters_stay_when_no_language_was_learned(spark):
    rows = [(1, "plain words", None), (2, "12 !", None), (3, None, None), (4, "Ж", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    nothing = language_id.LanguageModel([], None, None, language_id.LanguageSettings())
    assert sorted(r["doc_id"] for r in language_id.keep_identified(docs, nothing).collect()) == [1, 4]
