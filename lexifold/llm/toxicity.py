"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the stretches of toxic texts that
ordinary texts hardly have, one on ordinary text. A window is a word with the blanks
around it. Its margin is how many bytes shorter it compresses with the toxic
dictionary than with the ordinary one. Windows over thresholds are counted, and a
logistic function, calibrated on texts the dictionaries had not seen, turns the
counts into a score. Everything is learned from a bounded sample of labelled rows;
scoring covers every window of every text, each distinct one once per batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.common import empty_if_null, fresh, in_pieces, learnable

#: Stands at the end of both dictionaries and of every window, so that each window
#: compresses and even a short match shows in its length.
FRAME = b"<<0123456789abcdefghijklmnopqrstuvwxyz>>"


@dataclass(frozen=True)
class ToxicitySettings:
    """``toxic_docs`` and ``ordinary_docs`` bound the sample that is learned from; nothing else is bounded.

    A gram of ``gram`` bytes is toxic if at least ``least_docs`` toxic texts have it,
    at a significance of ``least_z``, and the share of ordinary texts with it is at
    most ``most_ratio`` of the share of toxic ones. Words longer than ``word_bytes``
    make several windows.
    """

    toxic_docs: int = 800
    ordinary_docs: int = 1600
    gram: int = 5
    least_docs: int = 4
    least_z: float = 5.0
    most_ratio: float = 0.05
    dictionary_bytes: int = 2048
    level: int = 3
    thresholds: tuple[int, ...] = (2, 3)
    folds: int = 3
    word_bytes: int = 64


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    settings: ToxicitySettings


# ---- windows ----------------------------------------------------------------


def _windows(text: str, settings: ToxicitySettings) -> list[bytes]:
    return [w for word in text.lower().encode("utf-8", "surrogatepass").split() for w in _cut(word, settings)]


def _cut(word: bytes, settings: ToxicitySettings) -> list[bytes]:
    size = settings.word_bytes
    if len(word) <= size:
        return [b" " + word + b" "]
    return [b" " + word[i : i + size] + b" " for i in range(0, len(word), size)]


class Margins:
    """Bytes by which a window is shorter with the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes, settings: ToxicitySettings) -> None:
        self.toxic, self.ordinary = (self._compressor(d, settings.level) for d in (toxic, ordinary))
        self.settings = settings

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
        dictionary.precompute_compress(level=level)
        return zstandard.ZstdCompressor(
            level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False
        )

    def of_word(self, word: bytes) -> int:
        return max(self.of_window(w) for w in _cut(word, self.settings)) if word else -255

    def of_window(self, window: bytes) -> int:
        framed = window + FRAME
        return len(self.ordinary.compress(framed)) - len(self.toxic.compress(framed))


# ---- learning ---------------------------------------------------------------


def _grams(windows: set[bytes], size: int) -> set[bytes]:
    return {w[i : i + size] for w in windows for i in range(len(w) - size + 1)}


def _stretches(window: bytes, grams: set[bytes], size: int) -> list[bytes]:
    """Maximal parts of a window that are covered by the grams."""
    found, start, end = [], None, 0
    for i in range(len(window) - size + 1):
        if window[i : i + size] in grams:
            if start is not None and i > end:
                found.append(window[start:end])
                start = None
            start, end = i if start is None else start, i + size
    return found if start is None else [*found, window[start:end]]


def _dictionary(often: Counter, size: int) -> bytes:
    """The most frequent strings, the most frequent last, where a match costs least."""
    content = b""
    for part, _ in sorted(often.items(), key=lambda x: (-x[1], x[0])):
        if part not in content and len(content) + len(part) <= size:
            content = part + content
    return content + FRAME


def train_dictionaries(toxic: list[set[bytes]], ordinary: list[set[bytes]], settings: ToxicitySettings) -> tuple[bytes, bytes]:
    """Dictionary contents from the distinct windows of toxic and of ordinary texts."""
    size = settings.gram
    in_toxic = Counter(g for t in toxic for g in _grams(t, size))
    in_ordinary = Counter(g for t in ordinary for g in _grams(t, size))
    n, m = max(1, len(toxic)), max(1, len(ordinary))

    def z(gram: bytes) -> float:
        both = (in_toxic[gram] + in_ordinary[gram]) / (n + m)
        return (in_toxic[gram] / n - in_ordinary[gram] / m) / np.sqrt(both * (1 / n + 1 / m))

    telling = {
        g
        for g, k in in_toxic.items()
        if k >= settings.least_docs and in_ordinary[g] / m <= settings.most_ratio * k / n and z(g) >= settings.least_z
    }
    stretches = Counter(s for t in toxic for s in {s for w in t for s in _stretches(w, telling, size)})
    words = Counter(w for t in ordinary for w in t)
    return _dictionary(stretches, settings.dictionary_bytes), _dictionary(words, settings.dictionary_bytes)


def _features(margins: list[np.ndarray], thresholds: tuple[int, ...]) -> np.ndarray:
    rows = []
    for m in margins:
        row = [1.0, float(max(m.max(), 0)) if len(m) else 0.0]
        for t in thresholds:
            over = int((m >= t).sum())
            row += [np.log1p(over), np.log1p(1000.0 * over / max(1, len(m)))]
        rows.append(row)
    return np.array(rows).reshape(len(rows), 2 + 2 * len(thresholds))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method with a small penalty."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - penalty * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings) -> DataFrame:
    """``(toxic, text)``: of the learnable labelled ids of each label the first by hash, with their texts."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = F.when(F.col("toxic") == 1, settings.toxic_docs).otherwise(settings.ordinary_docs)
    chosen = (
        labels.filter(learnable() & F.col("toxic").isin(0, 1))
        .select("doc_id", "toxic")
        .distinct()
        .withColumn("_r", F.row_number().over(order))
        .filter((F.col("_r") <= max(settings.toxic_docs, settings.ordinary_docs)) & (F.col("_r") <= most))
        .drop("_r")
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").select("toxic", "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None) -> ToxicityModel:
    """Learn from texts of the learnable documents and their ``toxic`` label, 1 or 0.

    Other labels are left aside. Without texts of both kinds every score is 0.
    """
    settings = settings or ToxicitySettings()
    seen = labelled_sample(docs, labels, settings).toPandas().drop_duplicates().sort_values(["toxic", "text"])
    share = labels.filter(learnable() & F.col("toxic").isin(0, 1)).agg(F.avg(F.col("toxic").cast("double")).alias("share")).first()["share"]
    windows = [_windows(t, settings) for t in seen["text"]]
    labelled = seen["toxic"].to_numpy(int)
    fold = np.zeros(len(labelled), int)
    for kind in (0, 1):
        of = np.flatnonzero(labelled == kind)
        fold[of] = np.random.default_rng(0).permutation(len(of)) % settings.folds
    width = 2 + 2 * len(settings.thresholds)
    if not 0 < labelled.sum() < len(labelled):
        return ToxicityModel(FRAME, FRAME, np.concatenate(([-30.0], np.zeros(width - 1))), settings)
    distinct = [set(w) for w in windows]

    def dictionaries(rows: np.ndarray) -> tuple[bytes, bytes]:
        kinds = [[distinct[i] for i in rows if labelled[i] == kind] for kind in (1, 0)]
        return train_dictionaries(*kinds, settings)

    features = np.zeros((len(labelled), width))
    for k in range(settings.folds):
        margins = Margins(*dictionaries(np.flatnonzero(fold != k)), settings)
        unseen, known = np.flatnonzero(fold == k), {}
        for i in unseen:
            known |= {w: margins.of_window(w) for w in distinct[i] if w not in known}
        features[unseen] = _features([np.array([known[w] for w in windows[i]], int) for i in unseen], settings.thresholds)
    weight = np.where(labelled == 1, share / labelled.mean(), (1 - share) / (1 - labelled.mean()))
    toxic, ordinary = dictionaries(np.arange(len(labelled)))
    return ToxicityModel(toxic, ordinary, _logistic(features, labelled, weight), settings)


# ---- scoring ----------------------------------------------------------------


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), named otherwise if those are taken.

    Null, empty and blank texts get the score of a text without any window over a
    threshold. Every row stays, repeated ones too; an empty table stays empty.
    """
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    source = docs.withColumn(fresh(docs, "_text"), empty_if_null())
    names = [*docs.columns, score, predicted]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        margins = Margins(fitted.toxic, fitted.ordinary, fitted.settings)
        for batch in in_pieces(batches, len(names) - 2):
            parts = pc.ascii_split_whitespace(pc.utf8_lower(batch.column(batch.num_columns - 1)))
            coded = parts.flatten().dictionary_encode()
            each = np.fromiter(
                (margins.of_word(w.encode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary)
            )
            windows = each[np.asarray(coded.indices)]
            offsets = np.asarray(parts.offsets)
            offsets = offsets - offsets[0]
            by_text = [w[w > -255] for w in (windows[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))]
            found = 1 / (1 + np.exp(-np.clip(_features(by_text, fitted.settings.thresholds) @ fitted.weights, -30, 30)))
            columns = [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.record_batch([*batch.columns[:-1], *columns], names)

    schema = docs.select("*").schema.add(score, "double").add(predicted, "integer")
    return source.mapInArrow(run, schema)
