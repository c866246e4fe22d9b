"""SimHash near-duplicates through the anchors of a covering code.

Fingerprints are compared per anchor. Anchors are the words of a product of
binary Golay codes on 23-bit blocks: each block of any fingerprint lies within
the covering radius 3 of exactly one code word. A fingerprint's home is that word
in every block. It is also replicated to every anchor within covering radius plus
threshold: for blocks at distance ``3 + e`` with the ``e`` adding up to the
threshold at most. If two fingerprints differ in so many bits or fewer, the home
of one is among the anchors of the other, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.llm.common import drop_documents, empty_if_null, in_pieces, join_groups, materialise, release_memory, small_batches

# Generator polynomial and length of the binary Golay code.
GOLAY_POLYNOMIAL = 0b101011100011
BLOCK_BITS = 23
CHECK_BITS = 11
COVERING_RADIUS = 3
SEED = 42


# ---- fingerprints -----------------------------------------------------------


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of one text, 0 for a text without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, count = xxhash.xxh64_digest, len(tokens) - size + 1
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)
    ones = np.zeros(64, np.int64)
    block: list[bytes] = []
    for a, b in spans:
        block.append(digest(line[a:b], SEED))
        if len(block) == 65_536:
            ones += _bit_sums(block)
            block = []
    if block:
        ones += _bit_sums(block)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def _bit_sums(digests: list[bytes]) -> np.ndarray:
    octets = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``, ``fp`` as a signed long; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1):
            found = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows
            ).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    source = docs.select("doc_id", empty_if_null().alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


# ---- anchors ----------------------------------------------------------------


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator polynomial."""
    rest = values.astype(np.uint64)
    for bit in range(BLOCK_BITS - 1, CHECK_BITS - 1, -1):
        set_ = (rest >> np.uint64(bit)) & np.uint64(1)
        rest = rest ^ (set_ * np.uint64(GOLAY_POLYNOMIAL << (bit - CHECK_BITS)))
    return rest.astype(np.int64)


@cache
def _patterns(extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns that lead to an anchor at distance ``COVERING_RADIUS + extra``.

    Sorted by syndrome, with the first position of each. For ``extra`` 0 it is the
    one pattern of weight 3 or less that leads home.
    """
    weights = range(COVERING_RADIUS + 1) if extra == 0 else (COVERING_RADIUS + extra,)
    found = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(BLOCK_BITS), w)], np.uint64)
    syndrome = _syndromes(found)
    order = np.argsort(syndrome, kind="stable")
    first = np.searchsorted(syndrome[order], np.arange((1 << CHECK_BITS) + 1))
    return found[order], first


def _expand(values: np.ndarray, rows: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, anchor) of 23-bit ``values`` at that distance."""
    patterns, first = _patterns(extra)
    syndrome = _syndromes(values)
    low, high = first[syndrome], first[syndrome + 1]
    many = high - low
    index = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    owner = np.repeat(np.arange(len(values)), many)
    return rows[owner], values[owner] ^ patterns[index]


def _blocks(fps: np.ndarray, blocks: int) -> list[np.ndarray]:
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    return [(fps >> np.uint64(BLOCK_BITS * b)) & mask for b in range(blocks)]


def anchors(fps: np.ndarray, threshold: int, blocks: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, home)`` of all anchors of ``fps`` within covering radius plus threshold."""
    parts = _blocks(fps, blocks)
    rows, keys, homes = [], [], []
    every = np.arange(len(fps))
    reach = [[_expand(p, every, e) for e in range(threshold + 1)] for p in parts]
    for extras in product(range(threshold + 1), repeat=blocks):
        if sum(extras) > threshold:
            continue
        row, key = reach[0][extras[0]]
        for b in range(1, blocks):
            other_row, other_key = reach[b][extras[b]]
            low = np.searchsorted(other_row, row, "left")
            many = np.searchsorted(other_row, row, "right") - low
            index = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            row, key = np.repeat(row, many), np.repeat(key, many) | (other_key[index] << np.uint64(BLOCK_BITS * b))
        rows.append(row)
        keys.append(key)
        homes.append(np.full(len(row), not any(extras)))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def replicate(prints: DataFrame, threshold: int, blocks: int = 2) -> DataFrame:
    """``(anchor, fp, home)``: each fingerprint at each of its anchors, ``home`` at the one it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 5_000):
                fps = every[at : at + 5_000]
                rows, keys, homes = anchors(fps, threshold, blocks)
                yield pa.record_batch(
                    [pa.array(keys.view(np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(homes)],
                    ["anchor", "fp", "home"],
                )
            release_memory()

    return prints.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(prints: DataFrame, threshold: int = 2, blocks: int = 2) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints in ``prints`` (distinct) within ``threshold`` bits, ``a < b``.

    No fingerprint has more than 2,080 others within two bits, so the pairs grow
    with the fingerprints and not with the square of a group. Both sides are shuffled:
    Spark takes replicas for no larger than the table of fingerprints, and would broadcast them.
    """
    placed = replicate(prints, threshold, blocks)
    home = placed.filter("home").select("anchor", F.col("fp").alias("a"))
    other = placed.select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return home.join(other.hint("merge"), "anchor").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


# ---- components -------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the least node reachable.

    Large-star and small-star steps alternate until nothing changes. Every round is
    written to the shared folder; only the count of changed edges comes back.
    """
    pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    for _ in range(max_rounds):
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        following = materialise(small, "stars")
        changed = following.join(pairs, ["a", "b"], "left_anti").count() + pairs.join(following, ["a", "b"], "left_anti").count()
        pairs = following
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2, blocks: int | None = None) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Words are what stands between ASCII white space, A-Z in lower case. Fewer
    words than a shingle make one shingle; texts without words, null ones too, have
    fingerprint 0 and are linked like all others. ``component_id`` is the least id
    reachable over links, ids that are null left aside; it is null if all are.
    Repeated rows each give a row. An empty table gives no rows; other columns are
    not read. ``blocks`` (1 or 2) only moves work between replication and comparison.
    """
    with small_batches(docs.sparkSession):
        printed = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(
        printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct_prints"
    )
    edges = materialise(links(nodes, threshold, blocks or 2), "print_links")
    member = materialise(components(edges), "print_components")
    rooted = (
        nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = materialise(rooted.join(least, "root").select("fp", "n", "component_id"), "print_labels")
    joined = join_groups(printed, labelled, ["fp"], "n", salt_by="doc_id")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """``docs`` with the document of least id of every component, all columns kept; rows without an id stay."""
    found = near_duplicates(docs, words, threshold)
    gone = materialise(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"), "near_dropped")
    return drop_documents(docs, gone)
