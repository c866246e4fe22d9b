"""Feature choice: which families a document is described by, and with which weights."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.operators.clusters import cluster_bridge, cluster_counts
from lexifold.operators.docvectors import attach_vectors, vector_features
from lexifold.operators.terms import bow_binary, bow_counts, vocabulary
from lexifold.operators.weights import fit_idf, idf_table, weighted
from lexifold.session import materialise


@dataclass(frozen=True)
class FeatureChoice:
    """Which features to compute.

    ``model`` is ``bow``, ``brown`` or ``word2vec``. ``bow_type`` is ``binary``;
    anything else means counts. ``plus_bow`` adds bag-of-words features to the
    other two, ``tfidf`` weights cluster and word counts (not binary ones), ``only_clusters`` uses
    leaf clusters only, ``cutoff`` leaves out the shortest path prefixes. Words
    next to document vectors are always weighted.
    """

    model: str = "bow"
    bow_type: str = "count"
    plus_bow: bool = False
    tfidf: bool = False
    only_clusters: bool = False
    cutoff: int = 0
    vector_size: int = 0

    def __post_init__(self) -> None:
        if self.model not in ("bow", "brown", "word2vec"):
            raise ValueError("model is bow, brown or word2vec")
        if self.model == "word2vec" and self.vector_size < 1:
            raise ValueError("document vectors need vector_size")
        if self.model == "bow" and self.bow_type == "binary" and self.tfidf:
            raise ValueError("tfidf weights counts, so bow_type cannot be binary")

    @property
    def weighs_words(self) -> bool:
        """Whether word counts are weighted."""
        if self.model == "bow":
            return self.tfidf
        return self.plus_bow and (self.model == "word2vec" or self.tfidf)


@dataclass
class FittedFeatures:
    """Tables learned from all documents, labelled or not."""

    choice: FeatureChoice
    bridge: DataFrame | None = None
    cluster_idf: DataFrame | None = None
    word_idf: DataFrame | None = None
    # The instances that were fitted and their written cluster counts, so that they are counted once.
    counted: tuple[DataFrame, DataFrame] | None = None

    def tables(self) -> dict[str, DataFrame]:
        """The tables that are there, by name."""
        named = {"bridge": self.bridge, "cluster_idf": self.cluster_idf, "word_idf": self.word_idf}
        return {name: table for name, table in named.items() if table is not None}

    def refit_idf(self, inst: DataFrame) -> FittedFeatures:
        """The same features with document frequencies of other documents."""
        fitted = replace(self)
        if self.cluster_idf is not None:
            fitted.cluster_idf = fit_idf(cluster_counts(inst, self.bridge), inst)
        if self.word_idf is not None:
            fitted.word_idf = fit_idf(bow_counts(inst), inst)
        return fitted

    def idf(self) -> DataFrame | None:
        """Rows ``(family, feature, idf)`` of all weighted families."""
        tables = [
            table.select(F.lit(family).alias("family"), "feature", "idf")
            for family, table in (("brown", self.cluster_idf), ("bow", self.word_idf))
            if table is not None
        ]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def counts(self, inst: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """Features ``(doc_id, family, feature, value)`` before weighting."""
        return reduce(DataFrame.unionByName, self._families(inst, vectors).values())

    def transform(self, inst: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """Features ``(doc_id, family, feature, value)``, weighted as chosen."""
        families = self._families(inst, vectors)
        for family, table in (("brown", self.cluster_idf), ("bow", self.word_idf)):
            if table is not None:
                families[family] = weighted(families[family], table)
        return reduce(DataFrame.unionByName, families.values())

    def _families(self, inst: DataFrame, vectors: DataFrame | None) -> dict[str, DataFrame]:
        choice = self.choice
        if choice.model == "bow":
            found = {"bow": bow_binary(inst) if choice.bow_type == "binary" else bow_counts(inst)}
        elif choice.model == "brown":
            same = self.counted is not None and self.counted[0] is inst
            found = {"brown": self.counted[1] if same else cluster_counts(inst, self.bridge)}
        else:
            if vectors is None:
                raise ValueError("document vectors are missing")
            docs = attach_vectors(inst.select("doc_id"), vectors, choice.vector_size)
            found = {"vector": vector_features(docs)}
        if choice.plus_bow and choice.model != "bow":
            found["bow"] = bow_counts(inst)
        return {family: table.withColumn("value", F.col("value").cast("double")) for family, table in found.items()}


def fit_features(
    inst: DataFrame, choice: FeatureChoice, paths: DataFrame | None = None, words: DataFrame | None = None
) -> FittedFeatures:
    """Learn vocabulary, clusters in use and idf from ``inst``.

    Instances are read several times; give a saved stage rather than a plan that
    starts from raw text. ``words`` is their vocabulary, if it is already written.
    """
    fitted = FittedFeatures(choice)
    if words is None and (choice.model == "brown" or choice.weighs_words):
        words = materialise(vocabulary(inst), "vocabulary")
    if choice.model == "brown":
        if paths is None:
            raise ValueError("cluster paths are missing")
        fitted.bridge = cluster_bridge(paths, words, choice.cutoff, choice.only_clusters)
        if choice.tfidf:
            fitted.counted = (inst, materialise(cluster_counts(inst, fitted.bridge), "cluster_counts"))
            fitted.cluster_idf = fit_idf(fitted.counted[1], inst)
    if choice.weighs_words:
        fitted.word_idf = idf_table(words.select(words["token"].alias("feature"), "df"), inst)
    return fitted
