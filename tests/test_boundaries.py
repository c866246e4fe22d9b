"""Learned sentence boundaries: planted abbreviations, starters, edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.operators import boundaries
from lexifold.session import materialise

TEXT = "We met Dr. Miller at noon. Then Dr. Brown spoke for long! The talk was good. Then we left the room. The rest stayed e.g. in bed."

OTHER = "At noon a good room long kept a bed in it and a good bed in a room at noon for long is what it was for us"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, f"{TEXT} {TEXT} {OTHER}") for i in range(60)] + [(100, None), (101, ""), (102, " . ")], "doc_id long, text string")


@pytest.fixture(scope="module")
def known(corpus):
    return boundaries.learn(corpus)


def test_planted_abbreviations_and_starters_are_learned(known):
    assert {"dr", "e.g"} <= set(known.abbreviations) and not {"noon", "good", "room", "bed"} & set(known.abbreviations)
    assert "then" in known.starters and "miller" not in known.starters


def test_sentences_run_on_behind_abbreviations(spark, corpus, known):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "He saw Dr. Then it rained."), (5, "Dr. Dr.\n Who? Yes.")], "k long, text string")
    found = {r["k"]: r["s"] for r in rows.select("k", boundaries.sentences(F.col("text"), known).alias("s")).collect()}
    rule = {r["k"]: r["s"] for r in rows.select("k", T.sentences(F.col("text")).alias("s")).collect()}
    assert found[1] == [
        "We met Dr. Miller at noon.", "Then Dr. Brown spoke for long!", "The talk was good.", "Then we left the room.", "The rest stayed e.g. in bed.",
    ]
    assert len(rule[1]) == 8 and found[2] == rule[2] == [""] and found[3] == [""]
    assert found[4] == ["He saw Dr.", "Then it rained."]
    assert found[5] == ["Dr. Dr. Who?", "Yes."]


def test_scores_by_hand(spark, corpus):
    counts = materialise(boundaries.period_counts(corpus), "period_counts")
    table = {r["word"]: r for r in counts.collect()}
    assert (table["dr"]["n"], table["dr"]["n_period"]) == (240, 240) and table["the"]["n_period"] == 0
    share = sum(r["n_period"] for r in table.values()) / sum(r["n"] for r in table.values())
    scored = {r["word"]: r for r in boundaries.abbreviation_scores(counts).collect()}
    assert scored["dr"]["score"] == pytest.approx(2 * 240 * (math.log(0.99) - math.log(share)) * math.exp(-2))
    assert "the" not in scored


def test_an_empty_corpus_learns_nothing(corpus):
    assert boundaries.learn(corpus.limit(0)) == boundaries.Boundaries()


def test_too_many_words_stop_the_job(corpus):
    with pytest.raises(ValueError, match="abbreviations"):
        boundaries.learn(corpus, most=1)
