"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. The lowest chunks of all ids form the
first level; a bitmap says which ids go on, and their next chunks form the next
level in the same order. A rank directory counts the ones of the bitmap before
every 512 bits, so that the place of an id on the next level, and with it any single
id, is found without decoding what stands before it.

Files are Parquet rows of one segment each, in the order (part, segment), so that
Spark commits them and any store it knows can hold them. A segment is self-contained:

====================  =======================================================
magic ``DAC1``        4 bytes
counts                documents, ids, first id of the segment in its part: u64
levels                u64, then the number of chunks on each: u64
document ids          i64, then one byte each: 1 where the id is null
document starts       u64, one more than documents
per level             chunks: u8; bitmap: u64 words; directory: u64
====================  =======================================================
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.llm.common import empty_if_null, in_pieces, partition_offsets, small_batches
from lexifold.llm.tokens import Encoder, crc32, with_end

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_IDS = 1_000_000
FILE_SCHEMA = "part int, segment int, n_docs long, n_ids long, payload binary"


# ---- one segment --------------------------------------------------------------


@dataclass
class Segment:
    doc_ids: np.ndarray
    null_ids: np.ndarray
    starts: np.ndarray
    first_id: int
    chunks: list[np.ndarray]
    bitmaps: list[np.ndarray]
    ranks: list[np.ndarray]

    def rank(self, level: int, at: int) -> int:
        """Ones of the bitmap before ``at``: the directory plus at most eight words."""
        words, block = self.bitmaps[level], at // RANK_BITS
        low, high = block * (RANK_BITS // 64), at // 64
        count = int(self.ranks[level][block]) + int(np.bitwise_count(words[low:high]).sum())
        if at % 64:
            count += int(words[high] & np.uint64((1 << (at % 64)) - 1)).bit_count()
        return count

    def id_at(self, at: int) -> int:
        """One id, by its place in the segment."""
        value = 0
        for level, chunks in enumerate(self.chunks):
            value |= int(chunks[at]) << (CHUNK_BITS * level)
            if level == len(self.bitmaps) or not int(self.bitmaps[level][at // 64]) >> (at % 64) & 1:
                break
            at = self.rank(level, at)
        return value

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids of places ``low`` to ``high``, without those before."""
        out = np.zeros(high - low, np.uint32)
        where = np.arange(high - low)
        for level, chunks in enumerate(self.chunks):
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if level == len(self.bitmaps):
                break
            words = self.bitmaps[level][low // 64 : -(-high // 64)]
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")[low % 64 : low % 64 + high - low].astype(bool)
            low = self.rank(level, low)
            high, where = low + int(bits.sum()), where[bits]
            if low == high:
                break
        return out


def pack_segment(doc_ids: np.ndarray, null_ids: np.ndarray, starts: np.ndarray, first_id: int, ids: np.ndarray) -> bytes:
    rest, chunks, bitmaps, ranks = ids.astype(np.uint32), [], [], []
    while True:
        chunks.append((rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8))
        more = rest >> np.uint32(CHUNK_BITS)
        on = more > 0
        if not on.any():
            break
        words = -(-len(on) // 64)
        bits = np.zeros(words * 8, np.uint8)
        packed = np.packbits(on, bitorder="little")
        bits[: len(packed)] = packed
        bitmap = bits.view("<u8")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(bitmap).astype(np.uint64))))
        bitmaps.append(bitmap)
        ranks.append(before[: -1 : RANK_BITS // 64].astype("<u8") if words else before[:0].astype("<u8"))
        rest = more[on]
    head = np.array([len(doc_ids), len(ids), first_id, len(chunks), *map(len, chunks)], "<u8")
    parts = [MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), null_ids.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for level, level_chunks in enumerate(chunks):
        parts.append(level_chunks.tobytes())
        if level < len(bitmaps):
            parts += [bitmaps[level].tobytes(), ranks[level].tobytes()]
    return b"".join(parts)


def open_segment(payload: bytes) -> Segment:
    """The parts of a segment as views of its bytes."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token codes")
    at = 4

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(payload, kind, count, at)
        at += found.nbytes
        return found

    n_docs, _, first_id, levels = (int(x) for x in take("<u8", 4))
    sizes = [int(x) for x in take("<u8", levels)]
    doc_ids, null_ids, starts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1)
    chunks, bitmaps, ranks = [], [], []
    for level, size in enumerate(sizes):
        chunks.append(take("u1", size))
        if level < levels - 1:
            words = -(-size // 64)
            bitmaps.append(take("<u8", words))
            ranks.append(take("<u8", -(-words // (RANK_BITS // 64))))
    return Segment(doc_ids, null_ids, starts.astype(np.int64), first_id, chunks, bitmaps, ranks)


# ---- files --------------------------------------------------------------------


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encode every text and write the ids in ascending order of ``doc_id``.

    A null text is empty and gives the end id alone. Null ids come first, repeated
    rows follow each other, an empty table gives no segments. Texts are moved once,
    to the range of their id; a segment holds about a million ids.
    """
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_if_null().alias("text"))
    ordered = source.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        segment, first = 0, 0
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, first
            column = pa.concat_arrays(keys)
            nulls = np.asarray(column.is_null())
            ids, starts = np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            payload = pack_segment(np.asarray(column.fill_null(0)), nulls, starts, first, ids)
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(column)]), pa.array([len(ids)]), pa.array([payload], pa.binary())],
                ["part", "segment", "n_docs", "n_ids", "payload"],
            )
            segment, first = segment + 1, first + len(ids)
            keys.clear(), held.clear(), sizes.clear()
            return row

        for batch in in_pieces(batches, 1):
            ids, starts = with_end(*encoder.encode(batch.column(1)), end_id)
            low = 0
            while low < batch.num_rows:
                room = SEGMENT_IDS - sum(map(len, held))
                high = max(low + 1, int(np.searchsorted(starts, starts[low] + room, "right")) - 1)
                keys.append(batch.column(0).slice(low, high - low))
                held.append(ids[starts[low] : starts[high]])
                sizes.append(np.diff(starts[low : high + 1]))
                low = high
                if sum(map(len, held)) >= SEGMENT_IDS or low < batch.num_rows:
                    yield flush()
        if keys:
            yield flush()

    with small_batches(docs.sparkSession, 2000):
        ordered.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files.

    ``start`` counts the ids of all documents before it: the totals of the parts,
    added up, and the place in the part.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    offsets = F.broadcast(partition_offsets(totals, "part", ["ids"]).select("part", "ids_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column(0), batch.column(1), strict=True):
                segment = open_segment(payload.as_py())
                starts, n = segment.starts, len(segment.doc_ids)
                ids = segment.ids(0, int(starts[-1]))
                sums = [crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array(segment.doc_ids, mask=segment.null_ids.astype(bool)),
                        pa.array(starts[:-1] + segment.first_id),
                        pa.array(np.diff(starts)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["part", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    schema = "part int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    read = files.select("part", "payload").mapInArrow(run, schema)
    return read.join(offsets, "part").select(
        "doc_id", (F.col("ids_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
