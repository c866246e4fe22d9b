"""Dense document vectors, given or trained."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.functions.vectors import vector_pairs
from lexifold.operators.lookup import lookup
from lexifold.operators.paragraphs import _average, _bytes, _start
from lexifold.operators.terms import explode_terms
from lexifold.session import discard, materialise, shuffles_removed

#: A block of documents has about this many tokens, fewer if that many vectors would be large.
BLOCK_TOKENS, BLOCK_WEIGHTS = 2_000_000, 32_000_000
#: Copies of words that are averaged at a time have about this many weights.
SHARD_WEIGHTS = 4_000_000
#: Occurrences that are trained at a time, the noise words they share, and for how many per pair these stand.
BATCH, NOISE, NEGATIVES = 1024, 64, 5
#: The pairs of a word that count in a batch, and how far its vector may go in one.
MOST, FARTHEST = 32, 0.5
#: Windows end after this many words, as in Spark's own trainer.
SENTENCE = 1000


def attach_vectors(docs: DataFrame, vectors: DataFrame, size: int, missing: str = "zero") -> DataFrame:
    """``docs`` with the vector of each document in ``vec``.

    A document without a vector gets zeros, is left out (``drop``) or fails the
    job (``error``).
    """
    if missing not in ("zero", "drop", "error"):
        raise ValueError("missing is zero, drop or error")
    known = vectors.select("doc_id", F.col("vec").cast("array<double>").alias("vec"))
    if missing == "drop":
        return docs.join(known, "doc_id")
    joined = docs.join(known, "doc_id", "left")
    if missing == "zero":
        default = F.array_repeat(F.lit(0.0), size)
    else:
        default = F.raise_error(
            F.concat(F.lit("no vector for document "), F.col("doc_id").cast("string"))
        ).cast("array<double>")
    return joined.withColumn("vec", F.coalesce("vec", default))


def vector_features(docs_with_vectors: DataFrame) -> DataFrame:
    """Vector components as features named by position."""
    return vector_pairs(docs_with_vectors).select(
        "doc_id",
        F.lit("vector").alias("family"),
        F.col("position").cast("string").alias("feature"),
        "value",
    )


def subsample_terms(inst: DataFrame, vocab: DataFrame, rate: float, seed: int = 1234) -> DataFrame:
    """Drop very frequent tokens at random, by the usual word-vector rule.

    A token with share ``f`` of all tokens is kept with probability
    ``(sqrt(f / rate) + 1) * rate / f``. The draw is a hash of seed, document and
    token, so it does not change when a task runs again. ``vocab`` must be a
    written table.
    """
    total = vocab.agg(F.sum("cf").cast("double")).scalar()
    share = F.col("cf") / total
    kept = vocab.select("token", "df", ((F.sqrt(share / rate) + 1) * rate / share).alias("chance"))
    name = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"), F.lit(":"), "token")
    digest = F.md5(name.cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    terms = lookup(explode_terms(inst.select("doc_id", "terms")), kept, ["token"], "df")
    survivors = (
        terms.filter(draw < F.col("chance"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("token", "tf"))).alias("terms"))
    )
    others = [c for c in inst.columns if c != "terms"]
    return inst.select(*others).join(survivors, "doc_id", "left").withColumn(
        "terms", F.coalesce("terms", F.expr(T.EMPTY_TERMS))
    )


def training_terms(df: DataFrame, order: str = "sequence") -> DataFrame:
    """Token lists to train on: in text order, or distinct tokens in token order."""
    if order == "sequence":
        return df.select("doc_id", "tokens")
    if order == "sorted_distinct":
        return df.select("doc_id", F.transform("terms", lambda t: t["token"]).alias("tokens"))
    raise ValueError("order is sequence or sorted_distinct")


@dataclass
class WordVectors:
    """Word vectors as a table ``(token, n, vec)``; ``vec`` has the bytes of ``size`` numbers."""

    words: DataFrame
    size: int
    num_partitions: int
    # The token lists that were trained on, as they were dealt, and the written words of their blocks.
    dealt: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def getVectors(self) -> DataFrame:
        """``(word, vector)``, as of Spark's own model."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [np.frombuffer(v, "<f4").astype(np.float64) for v in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.float64()))], ["word", "vector"])

        listed = self.words.select("token", "vec").mapInArrow(run, "word string, vector array<double>")
        return listed.withColumn("vector", array_to_vector("vector"))


def train_skip_grams(
    inner: np.ndarray, outer: np.ndarray, word: np.ndarray, before: np.ndarray, after: np.ndarray, noise: np.ndarray,
    window: int, rates: tuple[float, float], rng: np.random.Generator,
) -> None:
    """One pass over the occurrences ``word`` of a block; vectors change in place.

    The vectors of the neighbours (``inner``) learn to tell a word (``outer``) from noise words.
    ``before`` and ``after`` count the neighbours that an occurrence has in its sentence, and ``noise``
    has the running shares of the noise distribution. Occurrences are trained ``BATCH`` at a time; a
    word that takes part in more than ``MOST`` pairs of a batch takes a step as of so many, as steps that
    do not see each other would overshoot. The rate falls from the first of ``rates`` to the second.
    """
    for low in range(0, len(word), BATCH):
        high = min(low + BATCH, len(word))
        rate = rates[0] + (rates[1] - rates[0]) * low / len(word)
        first, last = max(0, low - window), min(len(word), high + window)
        reach = window - rng.integers(0, window, high - low)
        left, right = np.minimum(reach, before[low:high]), np.minimum(reach, after[low:high])
        mine, near = word[low:high], word[first:last]
        own, other = outer[mine], inner[near]
        own_turn, other_turn = np.zeros_like(own), np.zeros_like(other)
        own_pairs, other_pairs = (left + right).astype(np.float32), np.zeros(len(near), np.float32)
        for away in [*range(-window, 0), *range(1, window + 1)]:
            at = np.flatnonzero((left if away < 0 else right) >= abs(away))
            met = at + (low - first + away)
            one, two = own[at], other[met]
            pull = (1 / (1 + np.exp(np.einsum("ij,ij->i", one, two))))[:, None]
            own_turn[at] += pull * two
            other_turn[met] += pull * one
            other_pairs[met] += 1
        drawn = np.minimum(np.searchsorted(noise, rng.random(NOISE), "right"), len(outer) - 1)
        out = outer[drawn]
        share = other_pairs * np.float32(NEGATIVES / NOISE)
        push = share[:, None] / (1 + np.exp(-(other @ out.T)))
        other_turn -= push @ out
        _step(inner, near, other_turn, other_pairs * (1 + NEGATIVES), rate)
        out_pairs = np.full(NOISE, share.sum(), np.float32)
        _step(outer, np.concatenate((mine, drawn)), np.concatenate((own_turn, -(push.T @ other))), np.concatenate((own_pairs, out_pairs)), rate)


def _step(vectors: np.ndarray, word: np.ndarray, turn: np.ndarray, pairs: np.ndarray, rate: float) -> None:
    """Add up the turns of each word and move its vector by them."""
    order = np.argsort(word, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(word[order]) > 0)))
    many = np.add.reduceat(pairs[order], first)
    move = (rate * np.minimum(1.0, MOST / np.maximum(many, 1)))[:, None].astype(np.float32) * np.add.reduceat(turn[order], first)
    move *= np.minimum(1.0, FARTHEST / np.maximum(np.linalg.norm(move, axis=1), 1e-12))[:, None].astype(np.float32)
    vectors[word[order][first]] += move


def _deal(token_lists: DataFrame, layer_size: int, num_partitions: int) -> DataFrame:
    """Token lists with a block of a bounded number of tokens and a key that orders them within it."""
    n_tokens = token_lists.agg(F.sum(F.greatest(F.size("tokens"), F.lit(0)).cast("bigint"))).first()[0] or 0
    blocks = max(num_partitions, -(-n_tokens // max(1, min(BLOCK_TOKENS, BLOCK_WEIGHTS // layer_size))))
    key = F.xxhash64(F.col("doc_id").cast("string"), "tokens")
    return token_lists.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), key.alias("key"), "doc_id", "tokens")


def _compact(dealt: DataFrame, *keep: str) -> DataFrame:
    """Dealt documents with their tokens as one text, which takes a third of the room of a list, and the length of the list."""
    odd = F.exists("tokens", lambda t: t.contains("\0") | t.contains("\1"))
    plain = F.transform("tokens", lambda t: F.replace(F.replace(t, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\3")))
    joined = F.array_join(F.when(odd, plain).otherwise(F.col("tokens")), "\0")
    return dealt.select("block", *keep, F.greatest(F.size("tokens"), F.lit(0)).alias("length"), joined.alias("joined"))


def _needed(dealt: DataFrame) -> DataFrame:
    """The words ``(block, token, n)`` of each block and their occurrences, written."""
    listed = dealt.select("block", F.explode_outer("tokens").alias("token")).filter("token is not null")
    with shuffles_removed(dealt.sparkSession):
        return materialise(listed.groupBy("block", "token").agg(F.count(F.lit(1)).alias("n")), "word_blocks")


def _occurrences(docs: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The document of :func:`_compact` and the position in ``words`` of each token that is listed there, in order."""
    if not len(docs) or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    named = pc.replace_substring(pc.replace_substring(words.column("token"), "\1", "\1\2"), "\0", "\1\3").combine_chunks()
    filled = pc.greater(docs.column("length"), 0)
    lists = pc.split_pattern(pc.if_else(filled, docs.column("joined"), None), "\0").combine_chunks()
    at = pc.index_in(lists.flatten(), value_set=named.cast(lists.type.value_type))
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
    return owner[np.asarray(at.is_valid())], np.asarray(at.drop_null()).astype(np.int64)


def _word_epoch(dealt: DataFrame, known: DataFrame, size: int, window: int, rates: tuple[float, float], seed: int, epoch: int, last: bool) -> DataFrame:
    """Copies ``(block, token, n, vec)`` of the words of each block after it was trained.

    Behind the numbers of a word are those that predict it from its neighbours, which the ``last`` epoch leaves out.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("key"), right.sort_by("token").combine_chunks()
        if not len(right):
            return pa.table({"block": pa.array([], pa.int32()), "token": pa.array([], pa.string()), "n": pa.array([], pa.float64()), "vec": pa.array([], pa.binary())})
        block, token = right.column("block")[0].as_py(), right.column("token").to_pylist()
        both = np.zeros((len(right), 2 * size), np.float32)
        if right.column("vec").null_count:
            both[:, :size] = _start(token, size, seed)
        else:
            both[:] = np.frombuffer(b"".join(right.column("vec").to_pylist()), "<f4").reshape(both.shape)
        owner, word = _occurrences(left, right)
        begin, end = np.searchsorted(owner, owner, "left"), np.searchsorted(owner, owner, "right")
        place = np.arange(len(word)) - begin
        before = place % SENTENCE
        after = np.minimum(SENTENCE - 1 - before, end - begin - 1 - place)
        share = np.asarray(right.column("cf"), np.float64) ** 0.75
        inner, outer = np.ascontiguousarray(both[:, :size]), np.ascontiguousarray(both[:, size:])
        train_skip_grams(inner, outer, word, before, after, np.cumsum(share) / share.sum(), window, rates, np.random.default_rng([seed, block, epoch]))
        vec = _bytes(inner if last else np.hstack((inner, outer)))
        return pa.table({"block": right.column("block"), "token": right.column("token"), "n": right.column("n").cast(pa.float64()), "vec": vec})

    docs = _compact(dealt, "key").groupBy("block")
    return docs.cogroup(known.groupBy("block")).applyInArrow(run, "block int, token string, n double, vec binary")


def fit_word_vectors(
    token_lists: DataFrame,
    layer_size: int = 100,
    window_size: int = 5,
    epochs: int = 1,
    learning_rate: float = 0.025,
    min_word_frequency: int = 1,
    seed: int = 1234,
    max_weights: int | None = None,
    num_partitions: int = 8,
) -> WordVectors:
    """Train word vectors on all token lists with skip-grams and negative sampling.

    The documents are dealt by a hash to ``num_partitions`` blocks, or more if these would have more
    than ``BLOCK_TOKENS`` tokens each. In every epoch a block gets the vectors of just the words it holds and
    trains its own copies; copies are averaged by word, weighted by the occurrences behind
    them. The words are a table and never come to the driver, so ``max_weights`` stops a job only
    where it is given. The vectors depend on the blocks and not on the machine.
    """
    spark = token_lists.sparkSession
    dealt = _deal(token_lists, layer_size, num_partitions)
    counted = _needed(dealt)
    everywhere = F.sum("n").over(Window.partitionBy("token"))
    with shuffles_removed(spark):
        need = materialise(counted.withColumn("cf", everywhere).filter(F.col("cf") >= min_word_frequency), "word_need")
    discard(counted)
    if max_weights is not None:
        n_words = need.select("token").distinct().count()
        if n_words * layer_size > max_weights:
            raise ValueError(f"{n_words} words are too many for one model; raise min_word_frequency")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-need.count() * layer_size // SHARD_WEIGHTS))
    known, words = need.withColumn("vec", F.lit(None).cast("binary")), None
    for epoch in range(epochs):
        rates = tuple(learning_rate * max(1e-4, 1 - turn / epochs) for turn in (epoch, epoch + 1))
        copies = _word_epoch(dealt, known, layer_size, window_size, rates, seed, epoch, epoch == epochs - 1)
        with shuffles_removed(spark):
            older, words = words, materialise(_average(copies, shards), "word_vectors")
        known = need.join(words.select("token", "vec"), "token")
        if older is not None:
            discard(older)
    return WordVectors(words, layer_size, num_partitions, (token_lists, dealt, need))


def document_vectors(model: WordVectors, token_lists: DataFrame) -> DataFrame:
    """Mean word vector of each document as ``(doc_id, vec array<float>)``; words without a vector count as zero."""
    size = model.size
    if model.dealt is not None and model.dealt[0] is token_lists:
        _, dealt, need = model.dealt
    else:
        dealt = _deal(token_lists, size, model.num_partitions)
        need = _needed(dealt)
    key = dealt.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, word = _occurrences(left, right)
        vectors = np.frombuffer(b"".join(right.column("vec").to_pylist()), "<f4").reshape(len(right), size)
        length, means = np.asarray(left.column("length")), np.zeros((len(left), size))
        begin = np.searchsorted(owner, np.arange(len(left) + 1))
        for i in np.flatnonzero(np.diff(begin)):
            means[i] = vectors[word[begin[i] : begin[i + 1]]].sum(0, np.float64) / length[i]
        return pa.table({"doc_id": left.column("doc_id"), "vec": pa.array(list(means.astype(np.float32)), pa.list_(pa.float32()))})

    known = need.select("block", "token").join(model.words.select("token", "vec"), "token")
    docs = _compact(dealt, "doc_id").groupBy("block")
    return docs.cogroup(known.groupBy("block")).applyInArrow(run, f"doc_id {key}, vec array<float>")


def save_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Write ``(doc_id, vec)`` and return the table as read back."""
    return materialise(vectors.select("doc_id", "vec"), "vectors", path)
