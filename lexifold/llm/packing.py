"""Packing documents into windows by non-negative least squares over length combinations.

Documents are cut into whole windows and one rest. Only the histogram of the piece
lengths, at most one number per length, comes to the driver. There, combinations of
two and three lengths that fill a window exactly are enumerated, non-negative least
squares finds how often to repeat each so that the histogram is met, and the counts
are rounded. What is left over is packed greedily, longest first, in one line that
is cut at window ends, so only the very last window is padded. The plan says for
each length which of its pieces, by their number, go where; the numbers come from
counts per length and bucket and the order inside a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.common import empty_if_null, in_pieces, materialise, small_batches
from lexifold.llm.tokens import Encoder, crc32, with_end


@dataclass(frozen=True)
class PackSettings:
    """``fan`` is the number of triples tried for each longest length, ``sweeps`` those of the solver.

    Pieces of one length are numbered in ``buckets`` parts side by side.
    """

    window: int = 2048
    fan: int = 8
    sweeps: int = 20
    buckets: int = 64
    broadcast_rows: int = 200_000


# ---- plan -----------------------------------------------------------------------


@dataclass
class Plan:
    """Per row: pieces ``first`` to before the next row of that length, and where they go.

    In a combination piece ``first + i`` goes to sequence ``sequence + i`` at
    ``offset``. In the line it starts ``offset + i * length`` ids after the
    beginning of ``sequence``.
    """

    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    line: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(sequence, offset, length of the first part)`` of pieces."""
        key = (length.astype(np.int64) << 40) | number.astype(np.int64)
        at = np.searchsorted(self.keys, key, "right") - 1
        nth = key - self.keys[at]
        ahead = self.offset[at] + nth * length
        sequence = np.where(self.line[at], self.sequence[at] + ahead // window, self.sequence[at] + nth)
        offset = np.where(self.line[at], ahead % window, self.offset[at])
        return sequence, offset, np.minimum(length, window - offset)


def combinations(lengths: np.ndarray, window: int, fan: int) -> list[tuple[int, ...]]:
    """Pairs, and ``fan`` triples for each longest length, of present lengths that fill the window."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    found: list[tuple[int, ...]] = [(window,)] if present[window] else []
    for a in lengths[::-1].tolist():
        rest = window - a
        if rest < 1 or a == window:
            continue
        if rest <= a and present[rest]:
            found.append((a, rest))
        middle = np.arange(-(-rest // 2), min(a, rest - 1) + 1)
        middle = middle[present[middle] & present[rest - middle]] if len(middle) else middle
        picked = middle[np.unique(np.linspace(0, len(middle) - 1, min(fan, len(middle))).astype(int))] if len(middle) else []
        found += [(a, int(b), rest - int(b)) for b in picked]
    return found


def solve(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often to repeat each combination."""
    left, times = histogram.astype(float).tolist(), [0.0] * len(columns)
    uses = [sorted({n: c.count(n) for n in c}.items()) for c in columns]
    norms = [sum(m * m for _, m in u) for u in uses]
    for _ in range(sweeps):
        moved = 0.0
        for j, use in enumerate(uses):
            step = sum(m * left[n] for n, m in use) / norms[j]
            step = max(step, -times[j])
            if step:
                times[j] += step
                moved = max(moved, abs(step))
                for n, m in use:
                    left[n] -= m * step
        if moved < 0.5:
            break
    return np.array(times)


def make_plan(histogram: np.ndarray, settings: PackSettings) -> Plan:
    """The plan for ``histogram[length]`` pieces of each length up to the window."""
    lengths = np.flatnonzero(histogram)
    columns = combinations(lengths, settings.window, settings.fan)
    times = solve(histogram, columns, settings.sweeps)
    left, used = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    rows: list[tuple[int, int, int, bool]] = []
    sequences = 0
    for j in np.argsort(-times, kind="stable").tolist():
        count = {n: columns[j].count(n) for n in columns[j]}
        repeat = min(int(round(times[j])), *(int(left[n]) // m for n, m in count.items()))
        if repeat < 1:
            continue
        offset = 0
        for n in columns[j]:
            rows.append(((n << 40) | int(used[n]), sequences, offset, False))
            used[n] += repeat
            left[n] -= repeat
            offset += n
        sequences += repeat
    ahead = 0
    for n in lengths[::-1].tolist():
        if left[n]:
            rows.append(((n << 40) | int(used[n]), sequences, ahead, True))
            ahead += n * int(left[n])
    rows.sort()
    columns_ = [np.array(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
    return Plan(*columns_, sequences + -(-ahead // settings.window))


# ---- tables ---------------------------------------------------------------------


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """``(key, doc_id, doc_tokens, crcs, ids)`` per row of ``docs``; ``crcs`` has one value per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in in_pieces(batches, 2):
            ids, starts = with_end(*encoder.encode(batch.column(2)), end_id)
            each = [ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            sums = [[crc32(d[i : i + window]) for i in range(0, len(d), window)] for d in each]
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array(sums, pa.list_(pa.int64())),
                    pa.array([d.astype("<u4").tobytes() if d.itemsize == 4 else d.tobytes() for d in each], pa.binary()),
                ],
                ["key", "doc_id", "doc_tokens", "crcs", "ids"],
            )

    source = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", empty_if_null().alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"key long, doc_id {kind}, doc_tokens long, crcs array<long>, ids binary")


def _numbered(tokens: DataFrame, settings: PackSettings) -> tuple[DataFrame, np.ndarray]:
    """Pieces with their number among those of their length, and the histogram of lengths."""
    window = settings.window
    length = F.least(F.lit(window), F.col("doc_tokens") - F.col("start")).alias("length")
    bucket = F.pmod(F.xxhash64("doc_id", "crc"), F.lit(settings.buckets)).cast("int").alias("bucket")
    pieces = (
        tokens.select("key", "doc_id", "doc_tokens", F.posexplode("crcs").alias("nth", "crc"))
        .withColumn("start", F.col("nth").cast("long") * window)
        .select("key", "doc_id", "doc_tokens", "start", length, "crc", bucket)
    )
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "crc", "start", "key")
    ranked = materialise(pieces.withColumn("rank", F.row_number().over(order) - 1), "packed_pieces")
    counts = ranked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        counts.select("length", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")),
        "length_buckets",
    )
    histogram = np.zeros(window + 1, np.int64)
    for row in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    # At most window * buckets rows.
    numbered = ranked.join(F.broadcast(offsets.drop("n")), ["length", "bucket"])
    return numbered.withColumn("number", F.col("before") + F.col("rank")), histogram


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, settings: PackSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pieces, tokens)``: where every id of every document goes, and the written ids.

    Pieces are rows ``(key, doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset)``; ``key`` finds the row of ``tokens`` whose ``ids`` they are
    part of. A null or empty text is the end id alone. Repeated rows and null ids are
    documents of their own. An empty table gives no pieces.
    """
    settings = settings or PackSettings()
    spark, window = docs.sparkSession, settings.window
    with small_batches(spark, 2000):
        tokens = materialise(tokenise(docs, tokenizer, end_id, window), "token_ids")
    numbered, histogram = _numbered(tokens, settings)
    plan = spark.sparkContext.broadcast(make_plan(histogram, settings))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"key long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, piece long"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(i)) for i in (6, 5))
            sequence, offset, part = plan.value.place(length, number, window)
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(part), batch.column(3), batch.column(4), pa.array(sequence.astype(np.int64)), pa.array(offset.astype(np.int64)), batch.column(6)],
                names,
            )

    columns = ["key", "doc_id", "start", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("number").cast("long"), F.col("length").cast("long")]
    placed = materialise(numbered.select(*columns).mapInArrow(place, schema), "placed_pieces")
    whole = placed.filter(F.col("length") == F.col("piece")).drop("piece")
    cut = materialise(placed.filter(F.col("length") < F.col("piece")), "cut_pieces")
    near = F.broadcast(cut) if cut.count() <= settings.broadcast_rows else cut
    width = 2 if Encoder(tokenizer).dtype.itemsize == 2 else 4
    final = [n for n in names if n != "piece"]

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row.pop("ids"), f"<u{width}")
                rest, row["piece"] = row["piece"] - row["length"], None
                second = row | {
                    "start": row["start"] + row["length"], "length": rest, "sequence_id": row["sequence_id"] + 1, "offset": 0,
                }
                for half in (row, second):
                    half["ids_crc32"] = crc32(ids[half["start"] : half["start"] + half["length"]])
                    rows.append(half)
            table = pa.Table.from_pylist([{n: r[n] for n in final} for r in rows], pa.schema([(f.name, f.type) for f in batch.schema if f.name in final]))
            yield from table.select(final).to_batches()

    halves = near.join(tokens.select("key", "ids"), "key").select(*names, "ids").mapInArrow(halve, schema.rpartition(",")[0])
    return whole.unionByName(halves), tokens


def sequences(pieces: DataFrame, tokens: DataFrame, width: int = 2) -> DataFrame:
    """The packed windows themselves: ``(sequence_id, ids, doc_ids)`` in the order of the offsets."""
    chosen = pieces.join(tokens.select("key", "ids"), "key").select(
        "sequence_id", "offset", "doc_id",
        F.expr(f"substring(ids, cast(start * {width} + 1 as int), cast(length * {width} as int))").alias("part"),
    )
    gathered = chosen.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part", "doc_id"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["part"]))
    return gathered.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
