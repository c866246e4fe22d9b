"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.functions.vectors import vector_pairs
from lexifold.operators import assemble, boundaries, certificate, clusters, docvectors, machines, metrics, numbering, paragraphs, terms, weights
from lexifold.operators.svm import SvmSettings, class_sizes, fit_svm, vector_width
from lexifold.plans import crossval, featurize, train, tuning
from lexifold.session import materialise, scratch_path
from lexifold.sources import corpora, dictionary, ledger, libsvm, paths, results, tables

# Words the stop-word query removes.
STOPWORDS = ["the", "of", "and", "to", "in", "by", "is", "on", "it", "with", "for", "der", "die", "la", "le", "el"]

VECTOR_SIZE = 64
SOLVED = SvmSettings(c=0.1)


# ---- inputs ----------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_documents(spark, sf)


def _tokens(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return terms.tokenize(_docs(spark, sf), keep=("doc_id", *keep))


def _instances(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return terms.instances(_tokens(spark, sf, *keep))


def _held_out(spark: SparkSession, sf: str) -> DataFrame:
    items = tables.read_table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    return terms.instances(terms.tokenize(items))


def _both_parts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _instances(spark, sf)
        .withColumn("part", F.lit("train"))
        .unionByName(_held_out(spark, sf).withColumn("part", F.lit("test")))
    )


def _byte_path(word: str, first: int) -> F.Column:
    return F.lpad(F.conv(F.substring(F.md5(F.col(word).cast("binary")), first, 2), 16, 2), 8, "0")


def _cluster_paths(words: DataFrame) -> DataFrame:
    return words.select(_byte_path("token", 1).alias("path"), F.col("token").alias("word"))


def _saved_instances(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(_instances(spark, sf), "instances")


def _pretrained(spark: SparkSession, sf: str) -> DataFrame:
    table = tables.read_table(spark, sf, "embeddings")
    return table.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    table = tables.read_table(spark, sf, "labels")
    return table.select(F.col("quality").cast("double").alias("real"), F.col("toxic").cast("double").alias("predicted"))


def _language_number() -> F.Column:
    lang = F.col("lang")
    return F.when(lang == "en", 1.0).when(lang == "de", 2.0).when(lang == "fr", 3.0).otherwise(4.0)


def _language_labels(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, sf, "documents").select("doc_id", _language_number().alias("label"))


def _quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))


# ---- text ------------------------------------------------------------------


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def contraction_split(spark: SparkSession, sf: str) -> DataFrame:
    text = T.clean_text(F.col("text"))
    for word, contraction in (("the", "cannot"), ("la", "gimme"), ("of", "wanna"), ("der", "gotta")):
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {contraction} "))
    tokens = T.word_tokens(text)
    return _docs(spark, sf).select("doc_id", F.array_join(tokens, " ").alias("tokens"))


def stopword_removal(spark: SparkSession, sf: str) -> DataFrame:
    kept = terms.tokenize(_docs(spark, sf), stopwords=STOPWORDS)
    return kept.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def sentence_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.sentence_corpus(_docs(spark, sf))


def _period_counts(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(boundaries.period_counts(_docs(spark, sf)), "period_counts")


def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    found = boundaries.abbreviation_scores(_period_counts(spark, sf))
    return found.withColumn("score", F.round("score", 4))


def sentence_starters(spark: SparkSession, sf: str) -> DataFrame:
    counts = _period_counts(spark, sf)
    scores = materialise(boundaries.abbreviation_scores(counts), "abbreviations")
    return boundaries.starter_ratios(_docs(spark, sf), counts, scores).withColumn("ratio", F.round("ratio", 4))


def paragraph_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _instances(spark, sf).select("doc_id", T.term_list(F.col("terms")).alias("terms"))


# ---- vocabulary, bag of words, weights ---------------------------------------


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return terms.vocabulary(_instances(spark, sf))


def vocabulary_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of the training words, and the words of the test set added to it later."""
    path = scratch_path(spark, "dictionary")
    dictionary.add_words(spark, path, terms.explode_terms(_instances(spark, sf)))
    dictionary.add_words(spark, path, terms.explode_terms(_held_out(spark, sf)))
    return dictionary.read_dictionary(spark, path)


def ledger_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Weights after the training documents, after those of the test set, and after the French ones are gone."""
    path = scratch_path(spark, "ledger")
    inst = materialise(_instances(spark, sf, "lang"), "instances")
    ledger.record_batch(spark, path, inst)
    ledger.record_batch(spark, path, _held_out(spark, sf))
    ledger.compact(spark, path)
    ledger.record_batch(spark, path, inst.filter("lang = 'fr'"), leaves=True)
    each = [ledger.idf_as_of(spark, path, b).withColumn("batch", F.lit(b)) for b in (1, 2, 3)]
    return reduce(DataFrame.unionByName, each).withColumn("idf", F.round("idf", 6))


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return terms.corpus_stats(_instances(spark, sf), _held_out(spark, sf))


def bow_counts(spark: SparkSession, sf: str) -> DataFrame:
    return terms.bow_counts(_instances(spark, sf))


def bow_binary(spark: SparkSession, sf: str) -> DataFrame:
    return terms.bow_binary(_instances(spark, sf))


def _rounded(features: DataFrame, column: str = "weight") -> DataFrame:
    return features.withColumn(column, F.round(column, 6))


def bow_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    inst = _saved_instances(spark, sf)
    counts = terms.bow_counts(inst)
    scored = weights.apply_idf(counts, weights.fit_idf(counts, inst))
    return _rounded(scored.select("doc_id", "feature", F.col("value").alias("tf"), "df", "weight"))


def tfidf_fit_apply(spark: SparkSession, sf: str) -> DataFrame:
    inst = _saved_instances(spark, sf)
    idf = weights.fit_idf(terms.bow_counts(inst), inst)
    scored = weights.apply_idf(terms.bow_counts(_held_out(spark, sf)), idf)
    return _rounded(scored.select("doc_id", "feature", "weight"))


def tfidf_per_set(spark: SparkSession, sf: str) -> DataFrame:
    inst = materialise(_both_parts(spark, sf), "both_parts")
    counts = terms.bow_counts(inst, keep=("part", "doc_id"))
    scored = weights.apply_idf(counts, weights.fit_idf(counts, inst, within="part"), within="part")
    return _rounded(scored.select("part", "doc_id", "feature", "weight"))


def tfidf_running(spark: SparkSession, sf: str) -> DataFrame:
    inst = materialise(_both_parts(spark, sf), "both_parts")
    counts = terms.bow_counts(inst, keep=("part", "doc_id"))
    idf = weights.fit_idf_running(counts, inst, "part", ["train", "test"])
    scored = weights.apply_idf(counts, idf, within="part")
    return _rounded(scored.select("part", "doc_id", "feature", "weight"))


def train_test_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "lang", "source")
    return terms.union_once(docs.filter("source <> 'src0'"), docs.filter("lang = 'en' or source = 'src0'"))


# ---- word clusters -----------------------------------------------------------


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(terms.vocabulary(_instances(spark, sf)), "vocabulary")


def _prefixes(spark: SparkSession, sf: str, cutoff: int = 0, leaf_only: bool = False) -> DataFrame:
    words = _words(spark, sf)
    bridge = clusters.cluster_bridge(_cluster_paths(words), words, cutoff, leaf_only)
    return clusters.bridge_prefixes(bridge)


def brown_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return _prefixes(spark, sf)


def brown_prefixes_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return _prefixes(spark, sf, cutoff=2)


def brown_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return _prefixes(spark, sf, leaf_only=True)


def brown_prefixes_two_paths(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf)
    second = words.select(F.substring(_byte_path("token", 3), 1, 6).alias("path"), F.col("token").alias("word"))
    listed = _cluster_paths(words).unionByName(second).unionByName(second)
    return clusters.bridge_prefixes(clusters.cluster_bridge(listed, words))


def brown_known_words(spark: SparkSession, sf: str) -> DataFrame:
    listed = _cluster_paths(terms.vocabulary(_held_out(spark, sf)))
    return clusters.bridge_prefixes(clusters.cluster_bridge(listed, _words(spark, sf)))


def brown_partial_counts(spark: SparkSession, sf: str) -> DataFrame:
    inst = _saved_instances(spark, sf)
    listed = _cluster_paths(terms.vocabulary(_held_out(spark, sf)))
    choice = featurize.FeatureChoice(model="brown", cutoff=1)
    return featurize.fit_features(inst, choice, listed).transform(inst)


def cluster_paths_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "paths")
    paths.write_cluster_paths(_cluster_paths(terms.vocabulary(_instances(spark, sf))), path)
    return paths.read_cluster_paths(spark, path)


def _brown(spark: SparkSession, sf: str, **choice: object) -> DataFrame:
    inst = _saved_instances(spark, sf)
    words = materialise(terms.vocabulary(inst), "vocabulary")
    choice = featurize.FeatureChoice(model="brown", **choice)
    fitted = featurize.fit_features(inst, choice, _cluster_paths(words), words)
    return _rounded(fitted.transform(inst), "value")


def brown_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _brown(spark, sf)


def brown_leaf_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _brown(spark, sf, only_clusters=True)


def brown_plus_bow(spark: SparkSession, sf: str) -> DataFrame:
    return _brown(spark, sf, plus_bow=True)


def brown_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _brown(spark, sf, tfidf=True, cutoff=2)


def brown_plus_bow_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _brown(spark, sf, tfidf=True, plus_bow=True)


# ---- document vectors ----------------------------------------------------------


def pretrained_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id")
    return vector_pairs(docvectors.attach_vectors(docs, _pretrained(spark, sf), VECTOR_SIZE))


def vectors_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    saved = docvectors.save_vectors(_pretrained(spark, sf), scratch_path(spark, "vectors"))
    return vector_pairs(saved)


def vectors_plus_bow_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    inst = _saved_instances(spark, sf)
    choice = featurize.FeatureChoice(model="word2vec", plus_bow=True, vector_size=VECTOR_SIZE)
    fitted = featurize.fit_features(inst, choice)
    return _rounded(fitted.transform(inst, _pretrained(spark, sf)), "value")


def subsampled_terms(spark: SparkSession, sf: str) -> DataFrame:
    inst = _saved_instances(spark, sf)
    words = materialise(terms.vocabulary(inst), "vocabulary")
    return terms.explode_terms(docvectors.subsample_terms(inst, words, rate=1e-3))


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    lists = materialise(docvectors.training_terms(_tokens(spark, sf)), "token_lists")
    model = docvectors.fit_word_vectors(lists, layer_size=16, epochs=1)
    vectors = docvectors.document_vectors(model, lists)
    finite = F.forall("vec", lambda x: ~F.isnan(x))
    return vectors.select("doc_id", F.size("vec").cast("bigint").alias("n_components"), finite.alias("finite"))


# ---- files -----------------------------------------------------------------------


def labelled_lines(spark: SparkSession, sf: str) -> DataFrame:
    corpus = corpora.labelled_corpus(_docs(spark, sf), _language_number().cast("int"), "review")
    path = scratch_path(spark, "corpus")
    corpora.write_labelled_corpus(corpus, path)
    return corpora.with_numeric_label(corpora.read_labelled_lines(spark, path))


def labelled_line_terms(spark: SparkSession, sf: str) -> DataFrame:
    corpus = corpora.labelled_corpus(_docs(spark, sf), _language_number().cast("int"), "review")
    parsed = corpora.parse_labelled_lines(corpora.render_labelled_lines(corpus))
    counted = terms.instances(terms.tokenize(parsed, "data", keep=("name",), clean=False))
    return terms.explode_terms(counted, keep=("name",))


def sentence_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sentences")
    corpora.write_sentence_corpus(corpora.sentence_corpus(_docs(spark, sf)), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def review_json(spark: SparkSession, sf: str) -> DataFrame:
    lines = _docs(spark, sf).select("doc_id", F.to_json(F.struct(F.col("text").alias("reviewText"))).alias("value"))
    return corpora.good_reviews(corpora.parse_reviews(lines))


def review_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "reviews")
    docs = _docs(spark, sf)
    docs.select(
        F.to_json(F.struct(F.col("doc_id").alias("asin"), F.col("text").alias("reviewText"))).alias("value")
    ).write.text(path)
    reviews = corpora.good_reviews(corpora.read_reviews(spark, path, key="asin"))
    return reviews.select(F.col("doc_id").cast("bigint").alias("doc_id"), "reviewText")


def label_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.read_table(spark, sf, "labels").select(
        "doc_id",
        F.concat(F.col("quality").cast("string"), F.when(F.col("toxic") == 1, "?").otherwise("")).alias("label"),
    )
    good = corpora.good_labels(raw).select("doc_id", "label", F.lit(True).alias("usable"))
    bad = corpora.bad_labels(raw).select("doc_id", F.lit(None).cast("double").alias("label"), F.lit(False).alias("usable"))
    return good.unionByName(bad)


def instances_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    train_path, test_path = scratch_path(spark, "train"), scratch_path(spark, "test")
    tables.save_stage(_instances(spark, sf), train_path)
    tables.save_stage(_held_out(spark, sf), test_path)
    return (
        terms.explode_terms(tables.load_stage(spark, train_path))
        .withColumn("part", F.lit("train"))
        .unionByName(terms.explode_terms(tables.load_stage(spark, test_path)).withColumn("part", F.lit("test")))
    )


def problem_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    inst = _instances(spark, sf, "lang")
    labelled = inst.withColumn("label", _language_number()).drop("lang")
    path = scratch_path(spark, "problem")
    tables.save_stage(terms.bow_counts(labelled, keep=("doc_id", "label")), path)
    return tables.load_stage(spark, path)


def libsvm_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    inst = _saved_instances(spark, sf)
    features = terms.bow_binary(inst)
    index = assemble.feature_index(features)
    docs = inst.select("doc_id", F.col("doc_id").cast("double").alias("label"), "terms")
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(assemble.vectorize_terms(docs, index, binary=True), path)
    read = libsvm.read_libsvm(spark, path, index.count())
    parts = F.unwrap_udt("features")
    return read.select(
        F.col("label").cast("bigint").alias("doc_id"),
        F.explode(F.arrays_zip(parts["indices"].alias("idx"), parts["values"].alias("value"))).alias("pair"),
    ).select("doc_id", F.col("pair.idx").cast("bigint").alias("idx"), F.col("pair.value").alias("value"))


def predictions_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    results.write_predictions_file(_pairs(spark, sf), path)
    return _rounded_metrics(metrics.overall_metrics(results.read_predictions(spark, path)))


def predictions_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "log")
    scored = tables.read_table(spark, sf, "labels").select(
        "doc_id",
        F.col("quality").cast("double").alias("real"),
        F.col("toxic").cast("double").alias("predicted"),
        F.lit("predictions").alias("stage"),
    )
    for run_id, cost in (("first", 0.1), ("second", 1.0)):
        results.append_results(results.tag_run(scored, run_id, c=cost), path)
    return spark.read.parquet(path)


def result_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, one logged twice and once half-way; every row counts once."""
    path = scratch_path(spark, "result_log")
    scored = tables.read_table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("real"), F.col("toxic").cast("double").alias("predicted")
    )
    results.log_results(scored, path, "first", "predictions", c=0.1)
    results.log_results(scored.withColumn("predicted", -F.col("predicted")), path, "second", "predictions", c=1.0)
    results.log_results(scored, path, "second", "predictions", c=1.0)
    results.write_attempt(scored, path)
    return results.read_log(spark, path, "predictions")


def metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    for stage in ("first", "second"):
        report = metrics.class_metrics(_pairs(spark, sf)).withColumn("stage", F.lit(stage))
        results.append_results(results.tag_run(report, "run", c=0.1), path)
    return _rounded_metrics(spark.read.parquet(path).withColumn("stage", F.col("stage").cast("string")))


# ---- measures, folds, numbers ------------------------------------------------------


def _rounded_metrics(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_pairs(spark, sf))


def confusion_grid(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_grid(_pairs(spark, sf), [0.0, 1.0]).toDF("predicted", "real_0", "real_1")


def class_list(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_list(_pairs(spark, sf))


def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_metrics(metrics.class_metrics(_pairs(spark, sf)))


def overall_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_metrics(metrics.overall_metrics(_pairs(spark, sf)))


def metrics_by_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read_table(spark, sf, "documents").select("doc_id", "source")
    scored = tables.read_table(spark, sf, "labels").join(docs, "doc_id")
    pairs = scored.select(
        "source", F.col("quality").cast("double").alias("real"), F.col("toxic").cast("double").alias("predicted")
    )
    return _rounded_metrics(metrics.overall_metrics(pairs, by=["source"]))


def cv_folds(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read_table(spark, sf, "documents").select("doc_id")
    return numbering.assign_folds(docs, 10, seed=7).select("doc_id", "fold")


def cv_folds_equal(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read_table(spark, sf, "documents").select("doc_id")
    return numbering.assign_folds(docs, 7, seed=7, drop_tail=True).select("doc_id", "position", "fold")


def fold_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read_table(spark, sf, "documents").select("doc_id", "lang")
    folds = numbering.assign_folds(docs, 10, seed=7)
    held_out = numbering.in_fold(folds, 3).withColumn("stage", F.lit("validation"))
    trained = numbering.not_in_fold(folds, 3).withColumn("stage", F.lit("train"))
    return held_out.unionByName(trained).groupBy("stage", "lang").agg(F.count(F.lit(1)).alias("n"))


def running_number(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read_table(spark, sf, "documents").select("doc_id")
    numbered = numbering.number_in_order(docs, "doc_id")
    return numbered.select("doc_id", corpora.document_name(F.lit("en"), "_", F.col("position")).alias("name"))


def feature_index(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.feature_index(terms.bow_counts(_instances(spark, sf)))


# ---- learning ------------------------------------------------------------------------


def _proof(spark: SparkSession, sf: str, labels: DataFrame, settings: SvmSettings) -> DataFrame:
    """Rows per class, whether the solver met its tolerance, and whether it beats always naming the largest class."""
    inst = _saved_instances(spark, sf)
    choice = featurize.FeatureChoice(model="bow", bow_type="binary")
    model = train.train(inst, labels, choice, settings)
    scored = model.predict(train.labelled_instances(inst, labels))
    return _beats_majority(scored, []).withColumn("converged", F.lit(model.svm.converged))


def _beats_majority(scored: DataFrame, by: list[str]) -> DataFrame:
    """``(by…, label, n, beats_majority)``; only classes are left after the first aggregation."""
    right = F.sum((F.col("real") == F.col("predicted")).cast("bigint")).alias("right")
    counts = scored.groupBy(*by, F.col("real").alias("label")).agg(F.count(F.lit(1)).alias("n"), right)
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    better = F.sum("right").over(everything) > F.max("n").over(everything)
    return counts.select(*by, "label", "n", better.alias("beats_majority"))


def svm_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _proof(spark, sf, _quality_labels(spark, sf), SOLVED)


def svm_one_vs_one(spark: SparkSession, sf: str) -> DataFrame:
    return _proof(spark, sf, _language_labels(spark, sf), SOLVED)


def svm_one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    return _proof(spark, sf, _language_labels(spark, sf), replace(SOLVED, strategy="one_vs_rest"))


def model_reload_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a reloaded model predicts for each held-out document what the model did before."""
    inst = _saved_instances(spark, sf)
    choice = featurize.FeatureChoice(model="brown", plus_bow=True, tfidf=True)
    clustered = _cluster_paths(terms.vocabulary(inst))
    model = train.train(inst, _quality_labels(spark, sf), choice, SOLVED, paths=clustered)
    path = scratch_path(spark, "model")
    model.save(path)
    before = model.predict(_held_out(spark, sf)).withColumnRenamed("predicted", "before")
    after = train.TextModel.load(spark, path).predict(_held_out(spark, sf))
    return after.join(before, "doc_id").select("doc_id", (F.col("predicted") == F.col("before")).alias("same"))


CHOICES = {
    "bow": featurize.FeatureChoice(),
    "bow, weights": featurize.FeatureChoice(tfidf=True),
    "leaves, words, weights": featurize.FeatureChoice(model="brown", only_clusters=True, plus_bow=True, tfidf=True),
    "vectors": featurize.FeatureChoice(model="word2vec", vector_size=VECTOR_SIZE),
}


def feature_choices(spark: SparkSession, sf: str) -> DataFrame:
    """The features of four choices, added up per document, family and choice."""
    inst = _saved_instances(spark, sf)
    words = materialise(terms.vocabulary(inst), "vocabulary")
    found = []
    for name, choice in CHOICES.items():
        fitted = featurize.fit_features(inst, choice, _cluster_paths(words), words)
        rows = fitted.transform(inst, _pretrained(spark, sf) if choice.model == "word2vec" else None)
        total = F.round(F.sum(F.round("value", 6).cast("decimal(28,6)")), 3).cast("double").alias("total")
        found.append(rows.groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("n"), total).withColumn("choice", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


def _english_vectors(spark: SparkSession, sf: str) -> DataFrame:
    labels = tables.read_table(spark, sf, "documents").select(
        "doc_id", (F.col("lang") == "en").cast("double").alias("label")
    )
    choice = featurize.FeatureChoice(model="bow", bow_type="binary")
    return train.training_vectors(_saved_instances(spark, sf), labels, choice)[2]


def cross_validation_report(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    predictions = crossval.cross_validate(_english_vectors(spark, sf), k, SOLVED, seed=7)
    return metrics.class_metrics(predictions, by=["stage", "fold"])


def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    predictions = crossval.cross_validate(_english_vectors(spark, sf), 10, SOLVED, seed=7)
    return _beats_majority(predictions, ["stage", "fold"])


def cross_validation_refit(spark: SparkSession, sf: str) -> DataFrame:
    inst = _saved_instances(spark, sf)
    choice = featurize.FeatureChoice(model="brown", tfidf=True)
    paths_ = _cluster_paths(materialise(terms.vocabulary(inst), "vocabulary"))
    predictions = crossval.cross_validate_refit(
        inst, _quality_labels(spark, sf), 2, choice, SOLVED, paths=paths_, seed=7
    )
    return predictions.groupBy("stage", "fold", F.col("real").alias("label")).agg(F.count(F.lit(1)).alias("n"))


PARAGRAPHS = paragraphs.ParagraphSettings(size=50)


def paragraph_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Per language the documents, and whether planes between the vectors tell 85 % of them at least."""
    inst = _saved_instances(spark, sf)
    model = paragraphs.fit_paragraphs(inst, PARAGRAPHS)
    choice = featurize.FeatureChoice(model="word2vec", vector_size=PARAGRAPHS.size)
    vectors = train.training_vectors(inst, _language_labels(spark, sf), choice, vectors=materialise(model.docs, "vectors"))[2]
    told = fit_svm(vectors, SvmSettings(c=10.0)).transform(vectors)
    right = F.avg((F.col("label") == F.col("predicted")).cast("double"))
    return told.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (right >= 0.85).alias("apart"))


def reload_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a reloaded model infers for each unseen document the vector that the model did before."""
    model = paragraphs.fit_paragraphs(_saved_instances(spark, sf), PARAGRAPHS)
    path = scratch_path(spark, "paragraphs")
    model.save(path)
    before = model.infer(_held_out(spark, sf)).withColumnRenamed("vec", "before")
    after = paragraphs.ParagraphModel.load(spark, path).infer(_held_out(spark, sf))
    moved = F.exists("vec", lambda x: x != 0)
    return after.join(before, "doc_id").select("doc_id", (F.col("vec") == F.col("before")).alias("same"), moved.alias("moved"))


def subsampled_positions(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.kept_positions(_tokens(spark, sf))


def svm_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """Per pair of languages whether joins over weights and rows give what the solver says, within its tolerance."""
    inst = _saved_instances(spark, sf)
    choice = featurize.FeatureChoice(model="bow", bow_type="binary")
    vectors = train.training_vectors(inst, _language_labels(spark, sf), choice)[2]
    classes = list(class_sizes(vectors))
    pairs = [machines.Machine(b, a, SOLVED.c) for a, b in combinations(range(len(classes)), 2)]
    blocks = machines.pack_blocks(vectors, classes)
    solved = machines.fit_machines(blocks, vector_width(vectors), pairs, SOLVED.tol, SOLVED.max_iter, proved=False)
    named = F.array(*[F.array(F.lit(classes[m.negative]), F.lit(classes[m.positive])) for m in pairs])
    found = certificate.objectives(vectors, classes, pairs, solved, SOLVED.tol)
    names = named[F.col("machine")]
    return found.select(names[0].alias("negative"), names[1].alias("positive"), "n", "same", "within")


def tune_c_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid over ten folds, trained in the same passes."""
    grid = tuning.cost_grid(0.1, -1, 3)
    data = crossval.with_folds(_english_vectors(spark, sf), 10, seed=7)
    models = crossval.fold_models(data, grid, SOLVED)
    converged = all(model.converged for _, model in models)
    report = crossval.validate_folds(data, SOLVED, costs=grid, models=models)
    return _beats_majority(report, ["c", "stage", "fold"]).withColumn("converged", F.lit(converged))


def tune_random(spark: SparkSession, sf: str) -> DataFrame:
    ranges = tuning.VectorRanges(epochs=(1, 1), layer_size=(8, 16), window_size=(3, 5))
    tokenized = materialise(_tokens(spark, sf), "tokens")
    return tuning.tune_vectors(
        tokenized,
        terms.instances(tokenized),
        _quality_labels(spark, sf),
        tuning.random_trials(2, seed=7, ranges=ranges),
        k=2,
        settings=SvmSettings(c=1000.0, max_iter=100),
        seed=7,
    ).select("trial", "stage", "fold", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        clean_text,
        tokenize,
        contraction_split,
        stopword_removal,
        sentence_corpus,
        abbreviations,
        sentence_starters,
        paragraph_terms,
        vocabulary,
        vocabulary_versions,
        ledger_idf,
        corpus_stats,
        bow_counts,
        bow_binary,
        bow_tfidf,
        tfidf_fit_apply,
        tfidf_per_set,
        tfidf_running,
        train_test_union,
        brown_prefixes,
        brown_prefixes_cutoff,
        brown_prefixes_two_paths,
        brown_leaves,
        brown_known_words,
        brown_partial_counts,
        cluster_paths_file,
        brown_counts,
        brown_leaf_counts,
        brown_plus_bow,
        brown_tfidf,
        brown_plus_bow_tfidf,
        pretrained_vectors,
        vectors_roundtrip,
        vectors_plus_bow_tfidf,
        subsampled_terms,
        doc_vectors,
        paragraph_vectors,
        reload_vectors,
        subsampled_positions,
        labelled_lines,
        labelled_line_terms,
        sentence_file,
        review_json,
        review_file,
        label_quarantine,
        instances_roundtrip,
        problem_roundtrip,
        libsvm_roundtrip,
        predictions_file,
        predictions_log,
        result_log,
        metrics_log,
        confusion_matrix,
        confusion_grid,
        class_list,
        class_metrics,
        overall_metrics,
        metrics_by_source,
        cv_folds,
        cv_folds_equal,
        fold_filter,
        running_number,
        feature_index,
        feature_choices,
        svm_binary,
        svm_one_vs_one,
        svm_one_vs_rest,
        model_reload_predict,
        cross_validation,
        cross_validation_refit,
        svm_certificate,
        tune_c_grid,
        tune_random,
    )
}
