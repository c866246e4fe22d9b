"""The dictionary that only grows: numbers that stay, and writers that meet."""

import hashlib

import pytest

from lexifold.sources import dictionary as D


def tokens(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "token string")


def by_digest(words, first):
    ordered = sorted(words, key=lambda w: (hashlib.md5(w.encode()).hexdigest(), w))
    return {w: first + i for i, w in enumerate(ordered)}


def found(spark, path, version=None):
    return {r["token"]: r["idx"] for r in D.read_dictionary(spark, path, version).collect()}


def test_numbers_stay_when_words_arrive(spark, tmp_path):
    path = str(tmp_path / "d")
    assert found(spark, path) == {}
    assert D.add_words(spark, path, tokens(spark, "a", "b", "c", "a", None)) == 1
    first = by_digest("abc", 0)
    assert found(spark, path) == first
    assert D.add_words(spark, path, tokens(spark, "d", "b", "é", "")) == 2
    assert found(spark, path) == {**first, **by_digest(["d", "é", ""], 3)} and found(spark, path, 1) == first
    assert D.add_words(spark, path, tokens(spark, "a")) == 3
    assert len(found(spark, path, 3)) == 6
    with pytest.raises(ValueError, match="no version 9"):
        D.read_dictionary(spark, path, 9)


def test_of_two_writers_one_wins_and_the_other_adds_the_rest(spark, tmp_path):
    path = str(tmp_path / "d")
    D.add_words(spark, path, tokens(spark, "a"))
    one, two = (D.prepare_words(spark, path, tokens(spark, *w)) for w in ("bc", "cd"))
    D.commit_words(spark, path, *one)
    with pytest.raises(D.VersionTaken):
        D.commit_words(spark, path, *two)
    assert set(found(spark, path)) == set("abc")
    assert D.add_words(spark, path, tokens(spark, *"cd")) == 3
    numbers = found(spark, path)
    assert sorted(numbers.values()) == [0, 1, 2, 3] and numbers["d"] == 3


def test_writers_that_die_do_no_harm(spark, tmp_path):
    path = tmp_path / "d"
    D.add_words(spark, str(path), tokens(spark, "a"))
    D.prepare_words(spark, str(path), tokens(spark, "b"))
    (path / "commits" / "00000002").write_text("")
    assert set(found(spark, str(path))) == {"a"}
    assert D.add_words(spark, str(path), tokens(spark, "z")) == 3
    assert found(spark, str(path)) == {"a": 0, "z": 1}
