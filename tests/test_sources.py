import pytest
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexifold.operators import terms
from lexifold.operators.metrics import class_metrics
from lexifold.sources import corpora, libsvm, paths, results, tables
from tests.conftest import plan_of


def write_lines(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_labelled_line_shapes(spark, tmp_path):
    path = write_lines(
        tmp_path,
        "lines",
        ["n1 1 some text", "n2,1 some text", "n3\t2\tmore", "", "n4 3", "n5, ,4,  x, y", "n6 1 a b"],
    )
    rows = {r["name"]: (r["label"], r["data"]) for r in corpora.read_labelled_lines(spark, path).collect()}
    assert rows == {
        "n1": ("1", "some text"),
        "n2,1": ("some", "text"),
        "n3": ("2", "more"),
        "n4": ("3", ""),
        "n5,": ("4,", "x, y"),
        "n6": ("1", "a b"),
    }


def test_labels_strict_and_quarantined(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "2.5")], "name string, label string")
    assert {tuple(r) for r in corpora.good_labels(df).collect()} == {("a", 1.0), ("c", 2.5)}
    assert [r["name"] for r in corpora.bad_labels(df).collect()] == ["b"]
    with pytest.raises(PySparkException):
        corpora.with_numeric_label(df).collect()


def test_reviews(spark, tmp_path):
    path = write_lines(
        tmp_path,
        "reviews.json",
        ['{"asin": "k1", "reviewText": "Good one.", "overall": 5}', "{broken", '{"asin": "k2", "overall": 1}'],
    )
    reviews = corpora.read_reviews(spark, path, key="asin")
    assert [tuple(r) for r in corpora.good_reviews(reviews).collect()] == [("k1", "Good one.")]
    bad = corpora.bad_reviews(reviews).collect()
    assert {(r["doc_id"], r["_corrupt_record"]) for r in bad} == {(None, "{broken"), ("k2", None)}
    assert corpora.good_reviews(corpora.read_reviews(spark, path)).count() == 1


def test_review_schema_reads_only_the_text(spark, tmp_path):
    path = write_lines(tmp_path, "r.json", ['{"reviewText": "x", "other": 1}'])
    assert "ReadSchema: struct<reviewText:string>" in plan_of(corpora.read_reviews(spark, path).select("reviewText"))


def test_labelled_corpus_roundtrip(spark, corpus, tmp_path):
    made = corpora.labelled_corpus(corpus, F.lit(7), "_")
    corpora.write_labelled_corpus(made, str(tmp_path / "out"))
    back = corpora.with_numeric_label(corpora.read_labelled_lines(spark, str(tmp_path / "out")))
    rows = {r["name"]: (r["label"], r["data"]) for r in back.collect()}
    assert rows == {
        "7_1": (7.0, "the cat the cat the dog"),
        "7_2": (7.0, "a dog times"),
        "7_3": (7.0, ""),
        "7_4": (7.0, "the bird sings the dog barks"),
    }


def test_cutting_sentences_does_not_change_the_labelled_tokens(spark, corpus):
    whole = {r["doc_id"]: r["data"].split() for r in corpora.labelled_corpus(corpus, F.lit(1)).collect()}
    parts = corpora.sentence_corpus(corpus).orderBy("doc_id", "sentence_no").collect()
    for doc_id, tokens in whole.items():
        assert [t for r in parts if r["doc_id"] == doc_id for t in r["sentence"].split()] == tokens


def test_sentence_file_keeps_empty_sentences(spark, corpus, tmp_path):
    corpora.write_sentence_corpus(corpora.sentence_corpus(corpus), str(tmp_path / "s"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert sorted(lines) == sorted(["the cat the cat the dog", "a dog", "times", "", "the bird sings the dog barks"])


def test_cluster_paths_split_on_single_blanks(spark, tmp_path):
    path = write_lines(tmp_path, "paths", ["0110\tcat\t12", "01 dog", "0  x", "11"])
    rows = {tuple(r) for r in paths.read_cluster_paths(spark, path).collect()}
    assert rows == {("0110", "cat"), ("01", "dog"), ("0", "")}


def test_predictions_file_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "real double, predicted double")
    results.write_predictions_file(df, str(tmp_path / "p"))
    assert sorted(map(tuple, results.read_predictions(spark, str(tmp_path / "p")).collect())) == [(1.0, 2.0), (2.0, 2.0)]
    path = write_lines(tmp_path, "given.tsv", ["real\tpredicted", "1.0\t2.0", "3.0\t3.0"])
    assert sorted(map(tuple, results.read_predictions(spark, path).collect())) == [(1.0, 2.0), (3.0, 3.0)]


def test_results_are_appended_by_run_and_stage(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1.0)], "real double, predicted double")
    path = str(tmp_path / "log")
    for run in ("a", "b"):
        for stage in ("train", "validation"):
            tagged = results.tag_run(class_metrics(df), run, c=1.0).withColumn("stage", F.lit(stage))
            results.append_results(tagged, path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert "PartitionFilters: [isnotnull(run_id" in plan_of(back.filter("run_id = 'a'"))


def test_libsvm_lines(spark, tmp_path):
    rows = [(2.0, Vectors.sparse(5, [0, 4], [1.0, 0.5])), (1.0, Vectors.sparse(5, [], []))]
    libsvm.write_libsvm(spark.createDataFrame(rows, ["label", "features"]), str(tmp_path / "l"))
    lines = sorted(r["value"].strip() for r in spark.read.text(str(tmp_path / "l")).collect())
    assert lines == ["1.0", "2.0 1:1.0 5:0.5"]
    back = libsvm.read_libsvm(spark, str(tmp_path / "l"), 5).collect()
    assert {(r["label"], r["features"]) for r in back} == set(rows)


def test_stages_of_train_and_test_do_not_overwrite_each_other(spark, corpus, tmp_path):
    inst = terms.instances(terms.tokenize(corpus))
    tables.save_stage(inst.filter("doc_id < 3"), str(tmp_path / "train"))
    tables.save_stage(inst.filter("doc_id >= 3"), str(tmp_path / "test"))
    assert tables.load_stage(spark, str(tmp_path / "train")).count() == 2
    assert tables.load_stage(spark, str(tmp_path / "test")).schema == inst.schema
