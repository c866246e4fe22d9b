import hashlib

import pytest
from pyspark.sql import functions as F

from lexifold.operators.numbering import assign_folds, in_fold, not_in_fold, number_by_digest, number_in_order


def digest_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_number_by_digest_is_the_global_order(spark):
    ids = list(range(0, 5000, 7))
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    for digits in (1, 3):
        numbered = number_by_digest(df, F.concat(F.lit("5:"), F.col("doc_id").cast("string")), ["doc_id"], hex_digits=digits)
        order = [r["doc_id"] for r in numbered.orderBy("position").collect()]
        assert order == digest_order(ids, 5)
        assert [r["position"] for r in numbered.orderBy("position").collect()] == list(range(len(ids)))


@pytest.mark.parametrize("drop_tail", [False, True])
def test_folds(spark, drop_tail):
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    folds = {r["doc_id"]: r["fold"] for r in assign_folds(df, 10, seed=3, drop_tail=drop_tail).collect()}
    sizes = [list(folds.values()).count(f) for f in range(10)]
    assert max(sizes) - min(sizes) <= (0 if drop_tail else 1)
    order = digest_order(range(103), 3)
    kept = order[:100] if drop_tail else order
    assert folds == {doc: i % 10 for i, doc in enumerate(kept)}


def test_fold_filters_split_the_rows(spark):
    df = assign_folds(spark.range(50).withColumnRenamed("id", "doc_id"), 5, seed=1)
    assert in_fold(df, 2).count() == 10 and not_in_fold(df, 2).count() == 40
    assert in_fold(df, 2).join(not_in_fold(df, 2), "doc_id").count() == 0


def test_number_in_order_with_uneven_keys(spark):
    ids = [i**3 for i in range(-50, 200)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    numbered = number_in_order(df, "doc_id", buckets=8).collect()
    assert {r["doc_id"]: r["position"] for r in numbered} == {i: n for n, i in enumerate(sorted(ids))}
    assert number_in_order(df.filter("doc_id is null"), "doc_id").count() == 0
