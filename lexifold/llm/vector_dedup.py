"""Near-duplicate vectors by small-world graphs of shards.

Equal vectors are counted once. The others are dealt to shards of bounded size by
their hash; each shard gets a graph, whose nodes are balls of vectors that are all
linked to each other. For every two shards one task searches the graph of the second
for all balls of the first, so that every vector is a query to every shard once. Its
beam is widened until an audit against all nodes passes. Balls that the angle between
their centres decides are counted whole, the vectors of the others are compared in
double precision. A task returns a count per vector and a spanning forest of its
links, never the links themselves; the forests are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.llm.common import components, join_groups, materialise, small_batches
from lexifold.llm.vector_codes import usable
from lexifold.llm.vector_graphs import Graph, GraphSettings, build, search

#: Angles nearer than this to the bound are decided by the vectors themselves.
SLACK = 1e-6


@dataclass(frozen=True)
class LinkSettings:
    """Vectors with a cosine of ``threshold`` are linked.

    A shard has about ``shard_rows`` vectors, and there are ``least_shards`` at least.
    Searches start with ``beam``; ``audited`` balls of a shard are compared with all
    balls of the other, and ``recall`` of what is within reach must be found.
    """

    threshold: float = 0.95
    shard_rows: int = 50_000
    least_shards: int = 8
    beam: int = 32
    audited: int = 512
    recall: float = 0.995
    graph: GraphSettings = field(default_factory=GraphSettings)

    @property
    def angle(self) -> float:
        return float(np.arccos(self.threshold))

    @property
    def radius(self) -> float:
        """Two vectors of a ball are at most twice this apart, and so linked."""
        return 0.45 * self.angle


# ---- rows -------------------------------------------------------------------


def keyed(vectors: DataFrame) -> DataFrame:
    """``(vec_id, key, v)``: digest and bytes of the vector as doubles; both null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None else np.array(x, "<f8") + 0.0 for x in batch.column(1).to_pylist()]
            data = [None if x is None or not x.any() else x.tobytes() for x in rows]
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).hexdigest() for x in data]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.string()), pa.array(data, pa.binary())], ["vec_id", "key", "v"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    source = vectors.select("vec_id", F.when(usable("embedding"), F.col("embedding").cast("array<double>")).alias("embedding"))
    return source.mapInArrow(run, f"vec_id {kind}, key string, v binary")


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their magnitude."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- graphs -----------------------------------------------------------------

INDEX = "shard int, key string, n long, v binary, owner int, node int, links array<binary>"


def build_graphs(distinct: DataFrame, shards: int, settings: LinkSettings) -> DataFrame:
    """The vectors with the ball they belong to; a ball's centre has its number and its links per level."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("key")
        keys = np.array([int(k[:16], 16) for k in table.column("key").to_pylist()], np.uint64)
        graph = build(_units(table.column("v")).astype(np.float32), keys, settings.radius, settings.graph)
        number, links = np.full(len(table), -1, np.int32), [None] * len(table)
        number[graph.nodes] = np.arange(len(graph.nodes))
        for node, row in enumerate(graph.nodes.tolist()):
            links[row] = [level[node].tobytes() for level in graph.levels if node < len(level)]
        return pa.table(
            {
                "shard": table.column("shard"), "key": table.column("key"), "n": table.column("n"), "v": table.column("v"),
                "owner": pa.array(graph.owner), "node": pa.array(number), "links": pa.array(links, pa.list_(pa.binary())),
            }
        )

    dealt = distinct.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "n", "v")
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, INDEX)


@dataclass
class Balls:
    """A shard: its vectors, the ball of each, and per ball its centre, radius and weight."""

    keys: list[str]
    units: np.ndarray
    weight: np.ndarray
    owner: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    members: np.ndarray
    first: np.ndarray

    def of(self, ball: int) -> np.ndarray:
        return self.members[self.first[ball] : self.first[ball + 1]]


def _balls(table: pa.Table) -> Balls:
    """``table`` is sorted by key."""
    units, weight = _units(table.column("v")), np.asarray(table.column("n"))
    owner, number = np.asarray(table.column("owner")), np.asarray(table.column("node"))
    centres = np.empty(int(number.max()) + 1, np.int64)
    centres[number[number >= 0]] = np.flatnonzero(number >= 0)
    apart = np.arccos(np.clip(np.einsum("ij,ij->i", units, units[centres[owner]]), -1, 1))
    apart[centres] = 0.0
    radius = np.zeros(len(centres))
    np.maximum.at(radius, owner, apart)
    total = np.zeros(len(centres), np.int64)
    np.add.at(total, owner, weight)
    members = np.argsort(owner, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(centres)))))
    return Balls(table.column("key").to_pylist(), units, weight, owner, centres, radius, total, members, first)


def _graph(table: pa.Table, balls: Balls) -> Graph:
    rows = table.column("links").take(pa.array(balls.centres)).to_pylist()
    top = max(map(len, rows))
    levels = [np.stack([np.frombuffer(r[at], np.int32) for r in rows if len(r) > at]) for at in range(top)]
    return Graph(balls.units.astype(np.float32), balls.centres, levels, balls.owner)


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (the least node of each tree, for every node) after the links ``a, b`` are added."""
    labels = labels.copy()
    while len(a):
        one, two = labels[a], labels[b]
        low, high = np.minimum(one, two), np.maximum(one, two)
        apart = low < high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(labels, high, low)
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels = shorter
    return labels


def wide_enough(graph: Graph, queries: np.ndarray, reach: np.ndarray, settings: LinkSettings) -> tuple[int, int, int]:
    """``(beam, true, found)``: the first beam with which an audit of the first queries passes, and its counts."""
    some, within = queries[: settings.audited], reach[: settings.audited]
    true = some @ graph.vectors[graph.nodes].T >= within[:, None]
    beam = settings.beam
    while True:
        row, node, _ = search(graph, some, within, beam)
        found = int(true[row, node].sum())
        if found >= settings.recall * true.sum() or beam >= len(graph.nodes):
            return beam, int(true.sum()), found
        beam *= 2


def compare(one: Balls, two: Balls, graph: Graph, same: bool, settings: LinkSettings, block: int = 512):
    """Links of two shards: counts per vector of each, trees over their balls, and the audit.

    Within a shard every ball is a query, so links are counted at the query's end only.
    """
    angle = settings.angle
    counts = [np.zeros(len(one.weight), np.int64), np.zeros(len(two.weight), np.int64)]
    whole = [np.zeros(len(one.centres), np.int64), np.zeros(len(two.centres), np.int64)]
    shift = 0 if same else len(one.centres)
    labels = np.arange(shift + len(two.centres))
    queries = one.units[one.centres].astype(np.float32)
    reach = np.cos(np.minimum(np.pi, angle + one.radius + two.radius.max() + SLACK)).astype(np.float32) - np.float32(SLACK)
    audit = wide_enough(graph, queries, reach, settings)
    for low in range(0, len(queries), block):
        q, node, _ = search(graph, queries[low : low + block], reach[low : low + block], audit[0])
        q = q + low
        if same:
            other = q != node
            q, node = q[other], node[other]
        apart = np.arccos(np.clip(np.einsum("ij,ij->i", one.units[one.centres[q]], two.units[two.centres[node]]), -1, 1))
        spread = one.radius[q] + two.radius[node]
        sure = apart + spread <= angle - SLACK
        open_ = ~sure & (apart - spread <= angle + SLACK)
        np.add.at(whole[0], q[sure], two.total[node[sure]])
        if not same:
            np.add.at(whole[1], node[sure], one.total[q[sure]])
        linked = sure.copy()
        for at in np.flatnonzero(open_):
            a, b = one.of(q[at]), two.of(node[at])
            near = one.units[a] @ two.units[b].T >= settings.threshold
            linked[at] = near.any()
            counts[0][a] += near @ two.weight[b]
            if not same:
                counts[1][b] += one.weight[a] @ near
        labels = forest(labels, q[linked], node[linked] + shift)
    counts[0] += whole[0][one.owner]
    counts[1] += whole[1][two.owner]
    if same:
        counts[0] += one.total[one.owner] - 1
    return counts, labels, audit


FOUND = "key string, other string, links long, audited long, found long, beam int"


def link_shards(index: DataFrame, shards: int, settings: LinkSettings) -> DataFrame:
    """Counts ``(key, links)``, tree edges ``(key, other)`` and audits ``(audited, found, beam)`` of all pairs of shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in (("key", pa.string()), ("other", pa.string()), ("links", pa.int64()), ("audited", pa.int64()), ("found", pa.int64()), ("beam", pa.int32()))})
        same = left.column("a")[0] == left.column("b")[0]
        left, right = left.combine_chunks().sort_by("key"), right.combine_chunks().sort_by("key")
        one, two = _balls(left), _balls(right)
        counts, labels, audit = compare(one, two, _graph(right, two), same, settings)
        key, other, links = [], [], []
        for shard, count in ((one, counts[0]),) if same else ((one, counts[0]), (two, counts[1])):
            some = np.flatnonzero(count)
            key += [shard.keys[i] for i in some]
            links += count[some].tolist()
        other += [None] * len(key)
        centre = [one.keys[i] for i in one.centres] * (not same) + [two.keys[i] for i in two.centres]
        for node in np.flatnonzero(labels != np.arange(len(labels))):
            key.append(centre[node])
            other.append(centre[labels[node]])
        if same:
            for row in np.flatnonzero(one.centres[one.owner] != np.arange(len(one.owner))):
                key.append(one.keys[row])
                other.append(one.keys[one.centres[one.owner[row]]])
        links += [None] * (len(key) - len(links))
        n = len(key)
        return pa.table(
            {
                "key": pa.array([*key, None], pa.string()), "other": pa.array([*other, None], pa.string()),
                "links": pa.array([*links, None], pa.int64()), "audited": pa.array([None] * n + [audit[1]], pa.int64()),
                "found": pa.array([None] * n + [audit[2]], pa.int64()), "beam": pa.array([None] * n + [audit[0]], pa.int32()),
            }
        )

    pairs = shards * (shards + 1) // 2
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs, 10_000))
    mine = index.withColumns({"a": F.col("shard"), "b": F.explode(F.sequence(F.col("shard"), F.lit(shards - 1)))})
    theirs = index.withColumns({"a": F.explode(F.sequence(F.lit(0), F.col("shard"))), "b": F.col("shard")})
    one = mine.drop("links", "shard").repartition(tasks, "a", "b").groupBy("a", "b")
    two = theirs.drop("shard").repartition(tasks, "a", "b").groupBy("a", "b")
    return one.cogroup(two).applyInArrow(run, FOUND)


# ---- result -----------------------------------------------------------------


def near_duplicate_vectors(vectors: DataFrame, settings: LinkSettings = LinkSettings()) -> tuple[DataFrame, DataFrame]:
    """``(result, audits)`` for rows ``(vec_id, embedding)``; other columns, labels too, are not read.

    The result has ``(vec_id, n_links, component_id, kept)`` for every row: how many
    other rows are linked to it, the least id reachable over links, and whether that
    is its own. Vectors that are null, zero or hold null, NaN or infinite components
    link with nothing. Repeated rows and equal vectors are linked like others. Null
    ids are left aside where the least is sought; a null id is kept only if nothing
    linked to it has an id. Vectors of different lengths are an error. An empty table
    gives no rows. Audits are rows ``(audited, found, beam)``, one per pair of shards.
    """
    spark = vectors.sparkSession
    with small_batches(spark, 5_000):
        rows = materialise(keyed(vectors), "keyed_vectors")
    distinct = materialise(
        rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")),
        "distinct_vectors",
    )
    about = distinct.agg(F.count(F.lit(1)).alias("n"), F.min(F.octet_length("v")).alias("least"), F.max(F.octet_length("v")).alias("most")).first()
    if about["least"] != about["most"]:
        raise ValueError("vectors must have one length")
    shards = max(settings.least_shards, -(-about["n"] // settings.shard_rows))
    index = materialise(build_graphs(distinct, shards, settings), "vector_graphs")
    found = materialise(link_shards(index, shards, settings), "vector_links")
    counts = found.filter("links is not null").groupBy("key").agg(F.sum("links").alias("n_links"))
    member = materialise(components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))), "vector_components")
    rooted = materialise(
        distinct.select("key", "first_id", "n")
        .join(counts, "key", "left")
        .join(member.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "first_id", "n", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "key").alias("root")),
        "rooted_vectors",
    )
    least = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("keys")), "vector_classes")
    text = F.lit(64)
    classed = join_groups(rooted, least, ["root"], "keys", salt_by="key", row_bytes=text)
    labelled = materialise(classed.select("key", "n", "n_links", "component_id"), "vector_labels")
    joined = join_groups(rows.filter("key is not null").select("vec_id", "key"), labelled, ["key"], "n", salt_by="vec_id", row_bytes=text)
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = joined.select("vec_id", "n_links", "component_id").unionByName(alone)
    audits = found.filter("audited is not null").select("audited", "found", "beam")
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), audits
