"""Product codes of vectors, with nearest entries found by equal-average search.

Vectors of numbers become vectors of integers and are cut into equal consecutive
parts; each part is replaced by the index of the nearest entry of its codebook. An
entry whose component sum differs by ``g`` from that of a part of ``d`` numbers is at
a squared distance of ``g * g / d`` at least. So the entries are sorted by component
sum, and the search goes outward from the part's own sum, on both sides, until that
bound strictly exceeds the best distance found. Codebooks are trained in rounds; a
task returns one count and one sum per entry, whatever the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.llm.common import join_groups, materialise, small_batches

ROWS = 4096


@dataclass(frozen=True)
class CodeSettings:
    """``parts`` codebooks of ``entries`` entries, ``rounds`` of training; numbers are multiplied by ``scale``.

    Integers beyond ``largest`` stop the job, as squared distances would not fit a long.
    """

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    largest: int = 1 << 24


def usable(vector: str | Column) -> Column:
    """Whether a vector is neither null nor holds a null, NaN or infinite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integer_vectors(vectors: DataFrame, settings: CodeSettings) -> DataFrame:
    """``(vec_id, label, v)`` of all usable vectors, ``v`` the integers as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = np.floor(np.asarray(lists.flatten(), np.float64) * settings.scale)
            if len(flat) and np.abs(flat).max() > settings.largest:
                raise ValueError(f"components beyond {settings.largest / settings.scale} are too large for exact distances")
            ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            whole = flat.astype("<i4")
            rows = [whole[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["vec_id", "label", "v"])

    kept = vectors.filter(usable("embedding")).select("vec_id", "label", F.col("embedding").cast("array<double>"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    if kept.rdd.getNumPartitions() < cores:
        kept = kept.repartition(cores, "vec_id")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary")


def _parts(column: pa.Array, settings: CodeSettings) -> np.ndarray:
    """``(parts, rows, width)`` integers of the vectors of a batch."""
    rows = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), settings.parts, -1)
    return np.ascontiguousarray(rows.transpose(1, 0, 2))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry of ``book`` nearest to each row of ``x``; the lower index wins a tie."""
    width, (n, k) = max(1, x.shape[1]), (len(x), len(book))
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    own = x.sum(1)
    right = np.searchsorted(sums, own)
    sides = {-1: right - 1, 1: right}
    best, index = np.full(n, np.iinfo(np.int64).max // width), np.full(n, k)
    rows = np.arange(n)
    while len(rows):
        for step, at in sides.items():
            here = at[rows]
            inside = (here >= 0) & (here < k)
            gap = own[rows] - sums[np.clip(here, 0, k - 1)]
            inside &= gap * gap <= best[rows] * width
            at[rows[~inside]] = -1 if step < 0 else k
            some, here = rows[inside], here[inside]
            apart = x[some] - entries[here]
            distance, entry = np.einsum("ij,ij->i", apart, apart), order[here]
            better = (distance < best[some]) | (distance == best[some]) & (entry < index[some])
            best[some[better]], index[some[better]] = distance[better], entry[better]
            at[some] += step
        rows = rows[(sides[-1][rows] >= 0) | (sides[1][rows] < k)]
    return index, best


def first_books(kept: DataFrame, settings: CodeSettings) -> np.ndarray:
    """``(parts, entries, width)``: the parts of the vectors of least id; fewer vectors make fewer entries."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(settings.entries).select("v").collect()
    if not rows:
        return np.zeros((settings.parts, 0, 0), np.int64)
    return _parts(pa.array([bytes(r["v"]) for r in rows], pa.binary()), settings)


def improve(kept: DataFrame, books: np.ndarray, settings: CodeSettings) -> np.ndarray:
    """One round: every part goes to its nearest entry, which becomes the floored mean of its parts."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(batch.column(0), settings)):
                for low in range(0, len(x), ROWS):
                    index, _ = nearest(x[low : low + ROWS], shared.value[p])
                    np.add.at(sums[p], index, x[low : low + ROWS])
                    counts[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    found = kept.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    better = books.copy()
    # At most parts * entries rows.
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        better[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return better


def train_books(kept: DataFrame, settings: CodeSettings = CodeSettings()) -> np.ndarray:
    """Codebooks of written integer vectors, ``(parts, entries, width)``.

    Vectors of different length, or of a length that ``parts`` does not divide, are an error.
    """
    sizes = kept.agg(F.min(F.octet_length("v")).alias("least"), F.max(F.octet_length("v")).alias("most")).first()
    if sizes["least"] != sizes["most"] or (sizes["most"] or 0) % (4 * settings.parts):
        raise ValueError(f"vectors must have one length that {settings.parts} divides")
    books = first_books(kept, settings)
    for _ in range(settings.rounds if books.shape[1] else 0):
        books = improve(kept, books, settings)
    return books


def encode(kept: DataFrame, books: np.ndarray, settings: CodeSettings = CodeSettings()) -> DataFrame:
    """``(vec_id, label, code, error)``: entry indices in part order, two hex digits each, and the squared distance."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = _parts(batch.column(2), settings)
            found = [
                [np.concatenate(z) for z in zip(*[nearest(x[a : a + ROWS], shared.value[p]) for a in range(0, len(x), ROWS)], strict=True)]
                for p, x in enumerate(each) if len(x)
            ]
            if not found:
                continue
            codes = np.stack([index for index, _ in found], 1)
            text = ["".join(f"{i:02x}" for i in row) for row in codes.tolist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(sum(d for _, d in found))],
                ["vec_id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The integer vectors that rows of entry indices stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(books.shape[0])], axis=1)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, settings: CodeSettings = CodeSettings()) -> tuple[DataFrame, np.ndarray]:
    """Codes and codebooks of rows ``(vec_id, embedding, label)``; other columns are not read.

    Codes are rows ``(vec_id, code, error, label_error)``; ``label_error`` sums the
    errors of all rows of the same label, null labels together. Vectors that are null
    or hold null, NaN or infinite components are left out. Repeated rows count and
    are returned as often as they stand there; null ids come last where ids are
    ordered. Equal distances go to the lower index. An empty table gives no rows.
    """
    with small_batches(vectors.sparkSession, 10_000):
        kept = materialise(integer_vectors(vectors, settings), "integer_vectors")
        books = train_books(kept, settings)
        coded = materialise(
            encode(kept, books, settings).withColumns(
                {"_null": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
            ),
            "vector_codes",
        )
    sums = materialise(
        coded.groupBy("_label", "_null").agg(F.sum("error").cast("long").alias("label_error"), F.count(F.lit(1)).alias("_n")),
        "label_errors",
    )
    joined = join_groups(coded, sums, ["_label", "_null"], rows="_n", salt_by="vec_id", row_bytes=F.octet_length("_label") + 32)
    return joined.select("vec_id", "code", "error", "label_error"), books
