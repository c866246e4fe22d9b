"""Documents drawn by how much their words are those of a target.

The features of a text are hashed to buckets. Bucket counts of the corpus and of the
target give a gain per bucket, one array of them goes to every task, and the weight
of a document is the mean gain of its features. Gumbel noise from a digest of the id
makes the highest scores a draw without replacement. The cutoff between drawn and
not drawn is found by weighted median of medians: every task gives the median of its
remaining keys, the median of these weighted by the remaining sizes is a key with a
guaranteed fraction of all keys on either side, and the side that cannot hold the
cutoff is discarded, until the exact key is left. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.common import empty_if_null, in_pieces, materialise, partition_offsets, small_batches


@dataclass(frozen=True)
class DrawSettings:
    """Runs of 1 to ``runs`` words are features in ``buckets`` buckets.

    ``percent`` of the documents with ``least_words`` words are drawn; ``seed`` goes into the noise.
    """

    runs: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    scale: int = 1000


# ---- features ---------------------------------------------------------------


def _word_bytes() -> np.ndarray:
    """Which bytes belong to words: 0-9, A-Z, a-z and all of characters beyond ASCII."""
    table = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = True
    return table


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in lower case (A-Z only) as binary, and where those of each text begin."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _word_bytes()[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    kept = data[inside]
    kept = np.where((kept >= 0x41) & (kept <= 0x5A), kept + 32, kept).astype(np.uint8)
    begin = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(kept)])
    counted = np.concatenate(([0], np.cumsum(first)))
    return found, counted[offsets]


def _buckets(features: pa.Array, buckets: int) -> np.ndarray:
    coded = features.dictionary_encode()
    distinct = np.fromiter((zlib.crc32(f) % buckets for f in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return distinct[np.asarray(coded.indices)] if len(features) else np.zeros(0, np.int64)


def features(texts: pa.Array, settings: DrawSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, where those of each text begin, and the words of each text."""
    found, starts = words(texts)
    counts = np.diff(starts)
    left = np.repeat(starts[1:], counts) - np.arange(len(found))
    each, owners, run = [], [], found
    for size in range(1, settings.runs + 1):
        here = np.flatnonzero(left >= size)
        if size > 1:
            before = pa.array(np.searchsorted(previous, here))
            run = pc.binary_join_element_wise(run.take(before), found.take(pa.array(here + size - 1)), pa.scalar(b" ", pa.large_binary()))
        previous = here
        each.append(_buckets(run, settings.buckets))
        owners.append(np.repeat(np.arange(len(texts)), counts)[here])
    owner = np.concatenate(owners)
    ordered = np.argsort(owner, kind="stable") if settings.runs > 1 else slice(None)
    begin = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    return np.concatenate(each)[ordered], begin, counts


def featurise(docs: DataFrame, settings: DrawSettings, key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)`` per row; ``buckets`` are little-endian numbers of ``_width`` bytes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1):
            ids, begin, counts = features(batch.column(1), settings)
            stored = ids.astype(_width(settings))
            rows = [stored[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.array(counts), pa.array(np.diff(begin)), pa.array(rows, pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"],
            )

    source = docs.select(F.col(key).alias("doc_id"), empty_if_null().alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def _width(settings: DrawSettings) -> str:
    return "<u2" if settings.buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, settings: DrawSettings) -> np.ndarray:
    """Features per bucket over all rows; one number per bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                ids = np.frombuffer(b"".join(batch.column(0).slice(low, 1000).to_pylist()), _width(settings))
                counts += np.bincount(ids, minlength=settings.buckets)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])

    total = np.zeros(settings.buckets, np.int64)
    for row in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """What a feature of each bucket says for the target: the floored, scaled logarithm of smoothed shares."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(scale * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in pairs], np.int64)


def noise(doc_id: Column, settings: DrawSettings) -> Column:
    """Floored, scaled Gumbel noise from the first 32 bits of a digest of seed and id; a null id counts as empty."""
    text = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(settings.scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(found: DataFrame, gain: np.ndarray, settings: DrawSettings) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)``; the weight is the floored mean gain, 0 without features."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(shared.value[np.frombuffer(b.as_py(), _width(settings))].sum()) for b in batch.column(3)]
            n = np.asarray(batch.column(2))
            weight = np.floor_divide(np.array(sums, np.int64), np.maximum(n, 1))
            yield pa.record_batch([*batch.columns[:3], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    weighed = found.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings))


# ---- cutoff -----------------------------------------------------------------


def _middle(keys: np.ndarray) -> tuple[int, object]:
    return len(keys), keys[(len(keys) - 1) // 2] if len(keys) else None


def kth(table: DataFrame, column: str, k: int) -> tuple[object, int]:
    """The ``k``-th smallest value (from 1) of a written table's column without nulls, and how many are smaller.

    A round is one pass, and one row per task comes back: how many remaining keys lie
    below, at and above the pivot, and the median of those below and above. At least a
    quarter of the remaining keys is discarded every round.
    """
    named = table.schema[column].dataType.simpleString() == "string"
    kind, stored = ("string", pa.string()) if named else ("long", pa.int64())
    # Bounds are exclusive; None is open.
    low = high = pivot = None
    smaller = 0

    def look(low, high, pivot):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                inside = np.ones(len(keys), bool)
                if low is not None:
                    inside &= keys > low
                if high is not None:
                    inside &= keys < high
                held.append(keys[inside])
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
            first, last = (0, 0) if pivot is None else (np.searchsorted(keys, pivot, s) for s in ("left", "right"))
            below, above = _middle(keys[:first]), _middle(keys[last:])
            sizes = [pa.array([int(n)], pa.int64()) for n in (below[0], last - first, above[0])]
            medians = [pa.array([m if m is None or named else int(m)], stored) for m in (below[1], above[1])]
            yield pa.record_batch([*sizes, *medians], ["below", "same", "above", "low_median", "high_median"])

        return table.select(column).mapInArrow(run, f"below long, same long, above long, low_median {kind}, high_median {kind}").collect()

    rows = look(None, None, None)
    while True:
        if pivot is None:
            sizes = [(r["high_median"], r["above"]) for r in rows]
        else:
            below, same = sum(r["below"] for r in rows), sum(r["same"] for r in rows)
            if smaller + below < k <= smaller + below + same:
                return pivot, smaller + below
            if k <= smaller + below:
                high, sizes = pivot, [(r["low_median"], r["below"]) for r in rows]
            else:
                low, sizes = pivot, [(r["high_median"], r["above"]) for r in rows]
                smaller += below + same
        sizes = sorted((m, n) for m, n in sizes if n)
        half, running = sum(n for _, n in sizes) / 2, 0
        if not sizes:
            raise ValueError(f"there are fewer than {k} keys")
        for median, n in sizes:
            running += n
            if running >= half:
                pivot = median
                break
        rows = look(low, high, pivot)


def draw(scored: DataFrame, k: int) -> tuple[Column, Column]:
    """Conditions for the rows among the ``k`` highest scores of the written table ``scored`` that are
    surely drawn, and for those that tie with the last one drawn in score and id.

    Ties go to the smaller id; null ids come last.
    """
    if k < 1:
        return F.lit(False), F.lit(False)
    negative, above = kth(scored.select((-F.col("score")).alias("key")), "key", k)
    tied = scored.filter(F.col("score") == -negative)
    named = tied.filter(F.col("doc_id").isNotNull())
    at, higher = F.col("score") == F.lit(-negative), F.col("score") > F.lit(-negative)
    count = named.count()
    if k - above > count:
        return higher | (at & F.col("doc_id").isNotNull()), at & F.col("doc_id").isNull()
    last, _ = kth(named.select("doc_id"), "doc_id", k - above)
    return higher | (at & F.coalesce(F.col("doc_id") < F.lit(last), F.lit(False))), at & F.coalesce(F.col("doc_id") == F.lit(last), F.lit(False))


def resample(docs: DataFrame, target: DataFrame, settings: DrawSettings = DrawSettings()) -> DataFrame:
    """One row ``(doc_id, n_features, weight, score, rank)`` per row of ``docs``; ``target`` gives its column ``text``.

    ``rank`` numbers the drawn documents from 1 by descending score and ascending id
    and is null for the others. A null or empty text has no features and the weight 0;
    it is not drawn unless ``least_words`` is 0. Repeated rows count and are ranked one
    after another; if not all of them fit, as many are drawn as do. Null ids come last
    among ties. Empty tables give no rows, or counts of 0. Ids are integers or strings;
    other columns are not read.
    """
    spark = docs.sparkSession
    with small_batches(spark, 2000):
        found = materialise(featurise(docs, settings), "resample_features")
        wanted = target.select(F.lit(0).alias("doc_id"), "text")
        aimed = materialise(featurise(wanted, settings), "resample_target")
        gain = gains(bucket_counts(found, settings), bucket_counts(aimed, settings), settings.scale)
        scored = materialise(score(found, gain, settings), "resample_scores")
    ready = F.col("n_words") >= settings.least_words
    eligible = scored.filter(ready)
    k = eligible.count() * settings.percent // 100
    surely, tied = draw(eligible, k)
    surely, tied = ready & surely, ready & tied
    columns = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    chosen = materialise(scored.filter(surely | tied).select(*columns), "resample_winners")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(chosen.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "resample_order")
    offsets = F.broadcast(partition_offsets(laid.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "part", ["rows"]))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    number = (F.col("rows_before") + F.col("_place")).cast("long")
    # Only repeated ids can make more rows here than are drawn.
    drawn = laid.withColumn("_place", place).join(offsets, "part").select(*columns, F.when(number <= k, number).alias("rank"))
    rest = scored.filter(~(surely | tied)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
