"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability
for every piece, and the probability of a word is the sum over all ways to cut it
into pieces of the product of their probabilities: the forward algorithm. All pieces
and words of any length take part; long words are summed in logarithms. The
probabilities are fitted by expectation maximisation on a bounded sample of labelled
texts. A text is scored word by word, whole; a task computes each distinct word of
a batch once, for all languages and all words of a length together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.common import empty_if_null, fresh, in_pieces, learnable

UNDETERMINED = "und"
WORD_START = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NOT_LETTERS = r"[^\p{L}]+"


@dataclass(frozen=True)
class LanguageSettings:
    """``docs_per_language`` bounds the sample that is learned from; nothing of what is scored is bounded.

    Words of the sample with more than ``learned_chars`` letters are learned in parts of
    that length. ``prior`` is the weight, in pieces, of the mean of all languages in the
    probabilities of one. ``evidence`` is the number of words from which the score stops growing.
    """

    docs_per_language: int = 1000
    rounds: int = 3
    learned_chars: int = 500
    prior: float = 200.0
    evidence: int = 30


@dataclass
class Pieces:
    """Sorted hashes of the pieces; the place of a hash is the number of the piece, the last is any other character."""

    keys: np.ndarray
    by_size: dict[int, tuple[np.ndarray, np.ndarray]]
    longest: int

    @staticmethod
    def of(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
        ]
        hashes: dict[int, list[int]] = {}
        for piece in sorted({p for p in plain if p}):
            hashes.setdefault(len(piece), []).append(_hash(piece))
        keys = np.unique(np.array([h for of_size in hashes.values() for h in of_size], np.uint64))
        each = {n: np.unique(np.array(of_size, np.uint64)) for n, of_size in hashes.items()}
        return Pieces(keys, {n: (k, np.searchsorted(keys, k)) for n, k in each.items()}, max(each))

    def __len__(self) -> int:
        return len(self.keys) + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, -1 if there is none."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, -1)

    def starts(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For every size the number of the piece at every start of ``chars``, -1 if there is none."""
        rolled, width = np.zeros_like(chars), chars.shape[1]
        for size in range(1, min(self.longest, width) + 1):
            rolled = rolled[:, : width + 1 - size] * BASE + chars[:, size - 1 :]
            keys, places = self.by_size.get(size, (None, None))
            if keys is None:
                numbers = np.full(rolled.shape, -1)
            else:
                at = np.searchsorted(keys, rolled)
                at[at == len(keys)] = 0
                numbers = np.where(keys[at] == rolled, places[at], -1)
            if size == 1:
                numbers[numbers < 0] = len(self) - 1
            yield size, numbers


def _hash(piece: str) -> int:
    value = 0
    for c in piece:
        value = (value * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


#: Up to this many letters the product of the least probabilities is far from underflow.
PLAIN_CHARS = 24


def _by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length, in groups of about ``most`` characters: ``(rows, codes of the characters with the mark of the start)``."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[lengths > 0]):
        every = np.flatnonzero(lengths == n)
        for rows in np.array_split(every, -(-len(every) * (int(n) + 1) // most)):
            if not len(rows):
                continue
            line = WORD_START + WORD_START.join([words[r] for r in rows])
            codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n + 1)
            yield rows, codes.astype(np.uint64) + np.uint64(1)


def _found(chars: np.ndarray, pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(start, end, rows of the group, piece numbers)`` in the order of the ends."""
    found = []
    for size, numbers in pieces.starts(chars):
        for start in range(numbers.shape[1]):
            hit = np.flatnonzero(numbers[:, start] >= 0)
            if len(hit):
                found.append((start, start + size, hit, numbers[hit, start]))
    return sorted(found, key=lambda f: (f[1], f[0]))


def forward(words: list[str], pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Log probability of every word (rows) in every language (columns)."""
    out = np.zeros((len(words), probabilities.shape[1]))
    if not out.size:
        return out
    logs = np.log(probabilities)
    for rows, chars in _by_length(words, 200_000):
        if chars.shape[1] <= PLAIN_CHARS + 1:
            out[rows] = np.log(_prefixes(chars.shape, _found(chars, pieces), probabilities)[-1])
        else:
            out[rows] = _log_total(chars, pieces, logs)
    return out


def _prefixes(shape: tuple[int, int], found: list, probabilities: np.ndarray) -> np.ndarray:
    alpha = np.zeros((shape[1] + 1, shape[0], probabilities.shape[1]))
    alpha[0] = 1.0
    for start, end, hit, numbers in found:
        alpha[end, hit] += alpha[start, hit] * probabilities[numbers]
    return alpha


def _log_total(chars: np.ndarray, pieces: Pieces, logs: np.ndarray, block: int = 2048) -> np.ndarray:
    """The same for words of any length: sums of logarithms, of which only as many as the longest piece are kept."""
    count, width = chars.shape
    longest = min(pieces.longest, width)
    recent = np.full((longest + 1, count, logs.shape[1]), -np.inf)
    recent[0] = 0.0
    for low in range(0, width, block):
        first, high = max(0, low + 1 - longest), min(low + block, width)
        ending = np.full((longest, count, high - first), -1)
        for size, numbers in pieces.starts(chars[:, first:high]):
            ending[size - 1, :, size - 1 :] = numbers
        for end in range(low + 1, high + 1):
            numbers = ending[:, :, end - 1 - first]
            sizes = np.flatnonzero((numbers >= 0).any(axis=1))
            here = numbers[sizes]
            terms = np.where((here >= 0)[:, :, None], recent[(end - sizes - 1) % (longest + 1)] + logs[here], -np.inf)
            most = terms.max(axis=0)
            recent[end % (longest + 1)] = most + np.log(np.exp(terms - most).sum(axis=0))
    return recent[width % (longest + 1)]


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Expected number of every piece in every language; ``weights`` are word counts by language."""
    counts = np.zeros_like(probabilities)
    logs = np.log(probabilities)
    for rows, chars in _by_length(words, 200_000):
        found = _found(chars, pieces)
        plain = chars.shape[1] <= PLAIN_CHARS + 1
        if plain:
            alpha = _prefixes(chars.shape, found, probabilities)
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            scale = weights[rows] / alpha[-1]
        else:
            alpha = np.full((chars.shape[1] + 1, len(rows), logs.shape[1]), -np.inf)
            alpha[0] = 0.0
            for start, end, hit, numbers in found:
                alpha[end, hit] = np.logaddexp(alpha[end, hit], alpha[start, hit] + logs[numbers])
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            scale = weights[rows]
        for start, end, hit, numbers in reversed(found):
            if plain:
                through = probabilities[numbers] * beta[end, hit]
                share = alpha[start, hit] * through * scale[hit]
                beta[start, hit] += through
            else:
                through = logs[numbers] + beta[end, hit]
                share = np.exp(alpha[start, hit] + through - alpha[-1, hit]) * scale[hit]
                beta[start, hit] = np.logaddexp(beta[start, hit], through)
            for language in range(counts.shape[1]):
                counts[:, language] += np.bincount(numbers, share[:, language], len(counts))
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    probabilities: np.ndarray
    settings: LanguageSettings


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-cased letter runs of every text: codes, distinct words, first code of each text."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), NOT_LETTERS)
    coded = parts.flatten().dictionary_encode()
    offsets = np.asarray(parts.offsets)
    return np.asarray(coded.indices), coded.dictionary.to_pylist(), offsets - offsets[0]


def sample_words(docs: DataFrame, settings: LanguageSettings) -> DataFrame:
    """``(lang, word, n)`` of a bounded sample: per language the learnable rows first by a hash of id and text.

    Rows beyond a threshold, which follows from the number of rows of the language and
    leaves about twice as many as are wanted, go before anything is shuffled. If less is
    left, as where a third of the rows is one row repeated, the sample is smaller. Ties are equal rows.
    """
    lang = F.col("lang").cast("string")
    usable = docs.filter(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", lang.alias("lang"), "text")
    rows = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    wanted, scale = settings.docs_per_language, 1 << 30
    # One number per language: languages of a column are few.
    below = F.least(F.lit(float(scale)), F.lit(scale * 2.0 * wanted) / F.col("_rows")).cast("long")
    limits = F.broadcast(rows.select("lang", below.alias("_below")))
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale))
    some = usable.withColumn("_h", order).join(limits, "lang").filter("_h < _below")
    chosen = (
        some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text")))
        .filter(F.col("_r") <= wanted)
        .select("lang", "text")
    )
    words = F.explode(F.split(F.lower("text"), NOT_LETTERS)).alias("word")
    parted = F.regexp_extract_all("word", F.lit(f".{{1,{settings.learned_chars}}}"), F.lit(0))
    return (
        chosen.select("lang", words)
        .filter("word <> ''")
        .select("lang", F.explode(parted).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_languages(docs: DataFrame, vocabulary: str, settings: LanguageSettings | None = None) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the learnable documents (see ``common.learnable``).

    ``vocabulary`` is the path of a sentencepiece model, of which only the list of
    pieces is used. The sample comes to the driver as word counts.
    """
    settings = settings or LanguageSettings()
    seen = sample_words(docs, settings).toPandas()
    pieces = Pieces.of(vocabulary)
    languages = sorted(seen["lang"].unique())
    words = sorted(seen["word"].unique())
    row = {w: i for i, w in enumerate(words)}
    column = {c: i for i, c in enumerate(languages)}
    weights = np.zeros((len(words), len(languages)))
    weights[seen["word"].map(row).to_numpy(int), seen["lang"].map(column).to_numpy(int)] = seen["n"].to_numpy(float)
    probabilities = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(settings.rounds if languages else 0):
        counts = expected_counts(words, weights, pieces, probabilities)
        mean = (counts / counts.sum(axis=0)).mean(axis=1, keepdims=True) + 1e-3 / len(pieces)
        smoothed = counts + settings.prior * mean
        probabilities = smoothed / smoothed.sum(axis=0)
    return LanguageModel(languages, pieces, probabilities, settings)


def _score_batch(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    settings, count = model.settings, len(model.languages)
    codes, words, offsets = split_words(texts)
    if not count:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    by_word = forward(words, model.pieces, model.probabilities)
    real = np.fromiter((w != "" for w in words), bool, len(words))
    totals = np.zeros((len(texts), count))
    ends, starts = offsets[1:], offsets[:-1]

    def sums(values: np.ndarray) -> np.ndarray:
        running = np.concatenate(([0.0], np.cumsum(values[codes])))
        return running[ends] - running[starts]

    for language in range(count):
        totals[:, language] = sums(by_word[:, language])
    many = sums(real.astype(float))
    best = totals.argmax(axis=1)
    scaled = (totals - totals.max(axis=1, keepdims=True)) * np.minimum(1.0, settings.evidence / np.maximum(many, 1))[:, None]
    score = np.where(many > 0, 1.0 / np.exp(scaled).sum(axis=1), 0.0)
    return [model.languages[b] if m else UNDETERMINED for b, m in zip(best, many, strict=True)], score


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, named otherwise if ``docs`` has such columns.

    Texts that are null or have no letter are ``und`` with score 0, and so is every
    text if there was nothing to learn from. The score is the probability of the
    prediction among the languages, with at most ``evidence`` words counting. Of
    languages that are equally probable the first by name is predicted. Every row
    stays, repeated ones too; an empty table stays empty. Texts and words may be of any length.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    source = docs.withColumn(fresh(docs, "_text"), empty_if_null())
    names = [*docs.columns, pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, len(names) - 2, 3_000_000):
            found, sure = _score_batch(batch.column(batch.num_columns - 1), shared.value)
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(sure)], names)

    schema = docs.select("*").schema.add(pred, "string").add(score, "double")
    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the documents that have no language, or no letter if no language was learned."""
    if not model.languages:
        return docs.filter(empty_if_null().rlike(r"\p{L}"))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return identify(docs, model).filter(F.col(pred) != UNDETERMINED).drop(pred, score)
