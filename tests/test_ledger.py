"""The ledger of document frequencies against a recount."""

import math

import pytest

from lexifold.operators.terms import instances
from lexifold.sources import ledger as L


def docs(spark, texts):
    return instances(spark.createDataFrame([(i, t.split()) for i, t in texts.items()], "doc_id long, tokens array<string>"))


def recount(texts):
    df = {}
    for t in texts.values():
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    return {w: (n, pytest.approx(math.log10(len(texts) / n))) for w, n in df.items()}


def test_every_batch_equals_a_recount(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one, two = {1: "a b a", 2: "b c", 3: ""}, {4: "c d d", 5: "a"}
    found = lambda batch=None: {r["feature"]: (r["df"], r["idf"]) for r in L.idf_as_of(spark, path, batch).collect()}
    assert found() == {}
    assert L.record_batch(spark, path, docs(spark, one)) == 1
    assert L.record_batch(spark, path, docs(spark, two)) == 2
    assert L.compact(spark, path) == 2 and L.compact(spark, path) == 2
    assert L.record_batch(spark, path, docs(spark, {4: two[4], 3: one[3]}), leaves=True) == 3
    assert L.record_batch(spark, path, docs(spark, {9: "z z"})) == 4
    left = {1: one[1], 2: one[2], 5: two[5]}
    assert found(1) == recount(one) and found(2) == recount({**one, **two})
    assert found(3) == recount(left) and found() == found(4) == recount({**left, 9: "z z"})
    with pytest.raises(ValueError, match="no batch 7"):
        L.idf_as_of(spark, path, 7)


def test_a_batch_that_is_not_committed_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    L.record_batch(spark, path, docs(spark, {1: "a"}))
    monkeypatch.setattr(L, "commit_words", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        L.record_batch(spark, path, docs(spark, {2: "b"}))
    assert [r["feature"] for r in L.idf_as_of(spark, path).collect()] == ["a"]
