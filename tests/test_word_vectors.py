"""Word vectors as a table: planted topics, the same result on any cores, small blocks, odd rows."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from lexifold.operators import docvectors as D

SCHEMA = "doc_id long, tokens array<string>"


def topics(n=90, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [f"t{i % 3}w{w}" if rng.random() < 0.8 else f"c{w % 9}" for w in rng.integers(0, 20, 60)]) for i in range(n)]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(topics(), SCHEMA).repartition(3).cache()


def fitted(lists, **more):
    return D.fit_word_vectors(lists, layer_size=12, epochs=8, learning_rate=0.1, num_partitions=2, **more)


@pytest.fixture(scope="module")
def model(lists):
    return fitted(lists)


def words_of(model):
    return {r["word"]: r["vector"].toArray() for r in model.getVectors().collect()}


def test_words_are_a_table_and_words_of_a_topic_are_near(model):
    assert isinstance(model.words, DataFrame)
    found = {w: v / np.linalg.norm(v) for w, v in words_of(model).items() if w.startswith("t")}
    names = sorted(found)
    near = np.stack([found[w] for w in names]) @ np.stack([found[w] for w in names]).T
    np.fill_diagonal(near, -2)
    assert np.mean([names[i][:2] == w[:2] for w, i in zip(names, near.argmax(1), strict=True)]) > 0.95


def test_documents_are_means_of_their_words(lists, model):
    words, docs = words_of(model), {r["doc_id"]: r["vec"] for r in D.document_vectors(model, lists).collect()}
    assert len(docs) == 90
    for i, tokens in topics():
        assert np.allclose(docs[i], np.mean([words[t] for t in tokens], axis=0), atol=1e-6)


def test_the_result_does_not_depend_on_the_partitions(spark, lists, model):
    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "1")
    try:
        again = words_of(fitted(lists.coalesce(1)))
    finally:
        spark.conf.set(key, before)
    first = words_of(model)
    assert first.keys() == again.keys() and all((first[w] == again[w]).all() for w in first)


def test_more_tokens_make_more_blocks_and_not_larger_ones(lists, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_TOKENS", 600)
    assert D._deal(lists, 12, 2).groupBy("block").count().count() == 9
    assert len(words_of(fitted(lists))) == 69


def test_empty_and_repeated_documents_and_unknown_words(spark, model):
    # Other lists than those that were trained on; words without a vector count as zero.
    rows = [(1, []), (1, None), (None, ["t0w1", "new"]), (2, ["t0w1"]), (2, ["t0w1"]), (3, [None, "t0w1"])]
    words = words_of(model)["t0w1"]
    found = sorted((r["doc_id"] or 0, float(np.dot(r["vec"], words) / (words @ words))) for r in D.document_vectors(model, spark.createDataFrame(rows, SCHEMA)).collect())
    assert np.allclose([x for _, x in found], [0.5, 0, 0, 1, 1, 0.5], atol=1e-6) and [i for i, _ in found] == [0, 1, 1, 2, 2, 3]


def test_any_character_may_be_in_a_token(spark):
    rows = [(i, ["a\0b", "\1", "a", "b", "\0", ""]) for i in range(4)]
    lists = spark.createDataFrame(rows, SCHEMA)
    words, docs = words_of(made := fitted(lists)), D.document_vectors(made, lists).collect()
    assert set(words) == set(rows[0][1])
    assert all(np.allclose(r["vec"], np.mean([words[t] for t in rows[0][1]], axis=0), atol=1e-6) for r in docs)


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = fitted(none)
    assert model.getVectors().count() == 0 and D.document_vectors(model, none).count() == 0


def test_steps_stay_finite_where_one_word_is_everywhere():
    rng = np.random.default_rng(5)
    word = np.where(rng.random(20_000) < 0.7, 0, rng.integers(1, 50, 20_000))
    inner, outer = rng.normal(0, 0.1, (50, 8)).astype(np.float32), np.zeros((50, 8), np.float32)
    place = np.arange(20_000) % D.SENTENCE
    for _ in range(5):
        D.train_skip_grams(inner, outer, word, place, D.SENTENCE - 1 - place, np.arange(1, 51) / 50, 5, (0.1, 0.1), rng)
    assert np.isfinite(inner).all() and np.isfinite(outer).all() and np.abs(inner).max() < 50
