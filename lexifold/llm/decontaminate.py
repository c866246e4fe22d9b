"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks.

Windows of a document are as long as a benchmark item. To be similar enough, a
window must hold a least number of shingles of an item, in whatever order, so windows
are laid at every start that covers as many places with a shingle of items of that
size; all others are too dissimilar. Windows and items get SimHash fingerprints of their shingles, with repeats numbered so that
they do not add up in the same bits. Fingerprints are cut into
one block more than the radius: two of them within the radius agree in a block,
so joining on blocks finds all of them. The weighted Jaccard similarity of the
shingles, repeats counted, decides.

Everything here is column expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions.text import let
from lexifold.llm.common import drop_documents, empty_if_null, materialise

BITS = 64
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class Contract:
    """Shingle length in words, least similarity, and the radius of the fingerprint search.

    At similarity 0.8 fingerprints of numbered shingles differ in about 10 of 64 bits, with a standard
    deviation of about 3; a radius of 19 leaves three of those to spare.
    """

    words: int = 5
    similarity: float = 0.8
    radius: int = 19
    broadcast_rows: int = 500_000
    broadcast_bytes: int = 32 * 1024 * 1024


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(empty_if_null(text)), SPACE), lambda w: w != "")


def _shingle_strings(words: Column, k: Column | int) -> Column:
    """Shingles of ``k`` words, repeats included, in order."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, k), " ")),
    ).otherwise(F.expr("cast(array() as array<string>)"))


def _shingle_hashes(words: Column, k: int) -> Column:
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.slice(words, i + 1, k))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of strings: a bit is set if more than half of the hashes have it."""

    def bit(value: Column, at: Column) -> Column:
        return F.call_function("shiftrightunsigned", value, at).bitwiseAND(F.lit(1)).cast("int")

    def of(hashes: Column) -> Column:
        none = F.array_repeat(F.lit(0), BITS)
        ones = F.aggregate(hashes, none, lambda sums, h: F.transform(sums, lambda n, at: n + bit(h, at)))
        set_ = F.transform(
            ones,
            lambda n, at: F.when(
                n * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), at)
            ).otherwise(F.lit(0).cast("long")),
        )
        return F.aggregate(set_, F.lit(0).cast("long"), lambda all_, b: all_.bitwiseOR(b))

    return let(F.transform(shingles, lambda s: F.xxhash64(s)), of)


def numbered(shingles: Column) -> Column:
    """The shingles, each repeat of one followed by how many stand before it: a set as similar as the bags."""

    def of(s: Column) -> Column:
        before = lambda x, i: F.size(F.filter(F.slice(s, 1, i), lambda y: y == x))
        named = F.transform(
            s, lambda x, i: let(before(x, i), lambda n: F.when(n > 0, F.concat_ws(" ", x, n.cast("string"))).otherwise(x))
        )
        return F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(named)

    return let(shingles, of)


def _block_values(fingerprint: str, radius: int) -> Column:
    """``radius + 1`` pairs of block number and bits; the blocks cover all bits."""
    blocks = []
    for b in range(radius + 1):
        low, high = BITS * b // (radius + 1), BITS * (b + 1) // (radius + 1)
        bits = F.shiftrightunsigned(F.col(fingerprint), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        blocks.append(F.struct(F.lit(b).alias("block"), bits.alias("bits")))
    return F.explode(F.array(*blocks))


def weighted_jaccard(left: Column, right: Column) -> Column:
    """Sum of the smaller over sum of the larger count of every shingle of two arrays."""
    times = lambda bag, s: F.size(F.filter(bag, lambda x: x == s))
    shared = F.aggregate(F.array_distinct(left), F.lit(0), lambda n, s: n + F.least(times(left, s), times(right, s)))
    return let(shared, lambda n: n / (F.size(left) + F.size(right) - n))


def _small(df: DataFrame, contract: Contract) -> DataFrame:
    """A written table, marked for broadcast if its row count allows it."""
    return F.broadcast(df) if df.count() <= contract.broadcast_rows else df.hint("merge")


def _light(df: DataFrame, row_bytes: Column, contract: Contract) -> DataFrame:
    """A written table, marked for broadcast if its rows, as long as they are when read, allow it; files may be far smaller."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= contract.broadcast_bytes else df.hint("merge")


def _same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))


def _items(items: DataFrame, contract: Contract) -> DataFrame:
    """``(item_id, size, k, shingles, fp)`` of items that have words."""
    worded = items.select("item_id", _words("text").alias("words")).filter(F.size("words") > 0)
    sized = worded.select(
        "item_id", "words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(contract.words)).alias("k")
    )
    shingled = sized.select("item_id", "size", "k", let(F.col("words"), lambda w: _shingle_strings(w, F.col("k"))).alias("shingles"))
    return shingled.withColumn("fp", simhash(numbered(F.col("shingles"))))


def _covering_starts(places: Column, window: Column, need: Column, last: Column) -> Column:
    """Starts up to ``last`` of windows over ``window`` places that cover ``need`` of the sorted ``places``."""

    def of(at: Column) -> Column:
        # The starts whose first place is number i; those up to the place before it belong to that one.
        def starts(i: Column) -> Column:
            low = F.greatest(
                F.element_at(at, i + need) - window + 1, F.when(i > 0, F.get(at, i - 1) + 1).otherwise(F.lit(0)), F.lit(0)
            )
            high = F.least(F.element_at(at, i + 1), last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))

        return F.when(
            F.size(at) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), starts))
        ).otherwise(F.expr("cast(array() as array<int>)"))

    return let(places, of)


def _anchored_windows(docs: DataFrame, items: DataFrame, contract: Contract) -> DataFrame:
    """``(doc_id, text_hash, size, k, start, in_line)``: places where a window of that size may match.

    Similarity s of bags of a and b shingles needs s / (1 + s) * (a + b) shared ones.
    ``in_line`` says that a shingle stands in the window where it stands in an item.
    """
    hashes = F.posexplode(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))
    keyed = materialise(
        items.select("size", "k", hashes.alias("place", "hash")).distinct(), "item_shingles"
    )
    found = None
    for row in keyed.select("k").distinct().collect():
        k = int(row["k"])
        shingles = _small(materialise(keyed.filter(F.col("k") == k).drop("k"), "item_shingles_k"), contract)
        per_doc = docs.select("doc_id", F.xxhash64(empty_if_null()).alias("text_hash"), _words("text").alias("words")).select(
            "doc_id", "text_hash", F.size("words").alias("n_words"),
            F.posexplode(let(F.col("words"), lambda w, k=k: _shingle_hashes(w, k))).alias("at", "hash"),
        )
        last = F.greatest(F.col("n_words") - F.col("size"), F.lit(0))
        start = F.least(F.greatest(F.col("at") - F.col("place"), F.lit(0)), last)
        shared = (
            per_doc.join(shingles, "hash")
            .groupBy("doc_id", "text_hash", "n_words", "size")
            .agg(F.array_sort(F.collect_set("at")).alias("at"), F.collect_set(start).alias("lines"))
        )
        own, window = F.col("size") - (k - 1), F.least("size", "n_words") - (k - 1)
        need = F.ceil(contract.similarity / (1 + contract.similarity) * (own + window) - 1e-9).cast("int")
        laid = shared.select(
            "doc_id", "text_hash", "size", F.lit(k).alias("k"), "lines",
            F.explode(_covering_starts(F.col("at"), window, F.greatest(need, F.lit(1)), last)).alias("start"),
        ).select("doc_id", "text_hash", "size", "k", "start", F.array_contains("lines", F.col("start")).alias("in_line"))
        found = laid if found is None else found.unionAll(laid)
    return None if found is None else materialise(found, "anchored_windows")


def contaminated(docs: DataFrame, items: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Rows ``(doc_id, item_id, start_word, window_words, bit_distance, similarity)``.

    One row per document and item of which a window is similar enough: the most
    similar window; of equal ones the first in line with a shingle of the item, else the first. Words are lower-cased and split at
    white space. Items shorter than a shingle are one shingle; items without words
    and documents without words (null ones too) never match. Windows at the ends
    of a text are moved inside it, and shorter than the item if the text is. Rows
    that repeat an id and its text give one row. Other columns are not read.
    """
    contract = contract or Contract()
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word int, window_words int, bit_distance int, similarity double"
    indexed = materialise(_items(items, contract), "benchmark_items")
    windows = _anchored_windows(docs, indexed, contract)
    if windows is None:
        return spark.createDataFrame([], schema)
    per_text = materialise(
        windows.groupBy(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).agg(
            F.collect_set(F.struct("size", "k", "start", "in_line")).alias("places")
        ),
        "windows_per_text",
    )
    own = ["doc_id", "text_hash"]
    with_windows = _small(materialise(per_text.select("w_id", "w_hash"), "texts_with_windows"), contract)
    texts = docs.select("doc_id", "text", F.xxhash64(empty_if_null()).alias("text_hash"))
    found = materialise(texts.join(with_windows, _same_text(), "left_semi").distinct(), "window_texts")
    placed = found.join(per_text.hint("merge"), _same_text())
    cut = (
        placed.select(*own, _words("text").alias("words"), "places")
        .select(*own, "words", F.explode("places").alias("p"))
        .select(*own, "p.*", F.slice("words", F.col("p.start") + 1, F.col("p.size")).alias("window"))
    )
    fingerprint = let(_shingle_strings(F.col("window"), F.col("k")), lambda s: simhash(numbered(s)))
    printed = materialise(cut.select(*own, "size", "k", "start", "in_line", F.size("window").alias("n"), fingerprint.alias("fp")), "window_prints")
    keys = ["size", "block", "bits"]
    blocked_items = indexed.select("item_id", "size", F.col("fp").alias("item_fp"), _block_values("fp", contract.radius).alias("x"))
    blocked_items = blocked_items.select("item_id", "size", "item_fp", "x.*")
    blocked = printed.select("*", _block_values("fp", contract.radius).alias("x")).select(*printed.columns, "x.*")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    window = ["size", "k", "start", "in_line", "n", "item_id", "bit_distance"]
    candidates = (
        blocked.join(_small(materialise(blocked_items, "item_blocks"), contract), keys)
        .filter(distance <= contract.radius)
        .select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), *window[:-1], distance.alias("bit_distance"))
        .groupBy("w_id", "w_hash")
        .agg(F.collect_set(F.struct(*window)).alias("candidates"))
    )
    # Windows overlap, so their shingles are cut from the text again instead of being moved.
    item_shingles = indexed.select("item_id", F.col("shingles").alias("item_shingles"))
    verified = (
        found.join(candidates.hint("merge"), _same_text())
        .select(*own, _words("text").alias("words"), "candidates")
        .select(*own, "words", F.explode("candidates").alias("c"))
        .select(*own, "c.*", F.slice("words", F.col("c.start") + 1, F.col("c.size")).alias("window"))
        .join(_light(item_shingles, F.aggregate("item_shingles", F.lit(0).cast("bigint"), lambda n, s: n + F.octet_length(s) + 16), contract), "item_id")
        .withColumn("similarity", let(_shingle_strings(F.col("window"), F.col("k")), lambda s: weighted_jaccard(s, F.col("item_shingles"))))
        .filter(F.col("similarity") >= contract.similarity)
    )
    best = verified.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("similarity", "in_line", (-F.col("start")).alias("before"), "n", "bit_distance")).alias("b")
    )
    return best.select(
        "doc_id", "item_id", (-F.col("b.before")).alias("start_word"), F.col("b.n").alias("window_words"),
        F.col("b.bit_distance").alias("bit_distance"), F.col("b.similarity").alias("similarity"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, contract: Contract | None = None) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage, all columns kept."""
    found = materialise(contaminated(docs, items, contract).select("doc_id").distinct(), "contaminated")
    return drop_documents(docs, found)
