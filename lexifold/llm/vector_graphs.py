"""Hierarchical navigable small-world graphs in numpy, built and searched in batches.

Vectors are unit vectors. A vector within ``radius`` of one that stands in the graph
already joins its ball instead of the graph; the radius is at most half the angle
that links vectors, so the vectors of a ball are all linked to each other, and a group
of near copies costs as many nodes as it has balls. The graph is built level by level from the
top. Searches advance all queries of a batch in step, one node each at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class GraphSettings:
    """``links`` per node and level (twice as many on the ground), ``beam`` while building, ``batch`` nodes at a time."""

    links: int = 16
    beam: int = 64
    batch: int = 512


@dataclass
class Graph:
    """Nodes ``nodes`` (rows of ``vectors``) in order, links per level from the ground up, and the balls.

    The nodes of a level are the first ``sizes[level]``; ``owner`` has the node of every row.
    """

    vectors: np.ndarray
    nodes: np.ndarray
    levels: list[np.ndarray] = field(default_factory=list)
    owner: np.ndarray | None = None


def _top(similar: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` most similar per row, in descending order."""
    if similar.shape[1] > keep:
        best = np.argpartition(-similar, keep - 1, axis=1)[:, :keep]
        similar, ids = np.take_along_axis(similar, best, 1), np.take_along_axis(ids, best, 1)
    order = np.argsort(-similar, axis=1, kind="stable")
    return np.take_along_axis(similar, order, 1), np.take_along_axis(ids, order, 1)


def beam_search(
    vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(similarity, node)`` of the ``beam`` best nodes found per query, descending; ``-1`` fills the rest.

    ``entry`` holds the nodes each query starts from (-1: none). A search ends when no
    unexpanded node is left in its beam.
    """
    n, width = len(queries), links.shape[1]
    seen = np.zeros((n, len(links) + 1), bool)
    seen[:, -1] = True
    rows = np.arange(n)[:, None]
    similar = np.einsum("qd,qed->qe", queries, vectors[entry])
    similar[entry < 0] = -2.0
    seen[rows, entry] = True
    similar, ids = _top(similar, entry, beam)
    if similar.shape[1] < beam:
        pad = ((0, 0), (0, beam - similar.shape[1]))
        similar, ids = np.pad(similar, pad, constant_values=-2.0), np.pad(ids, pad, constant_values=-1)
    done = ids < 0
    active = np.arange(n)
    while len(active):
        open_ = ~done[active]
        going = open_.any(1)
        active, open_ = active[going], open_[going]
        if not len(active):
            break
        at = open_.argmax(1)
        done[active, at] = True
        near = links[ids[active, at]]
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        owner, place = np.nonzero(new)
        fresh = near[owner, place]
        value = np.einsum("ij,ij->i", queries[active[owner]], vectors[fresh])
        # Only what beats the worst of the beam is merged.
        better = value > similar[active[owner], -1]
        owner, fresh, value = owner[better], fresh[better], value[better]
        if not len(owner):
            continue
        many = np.bincount(owner, minlength=len(active))
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        touched = np.flatnonzero(many)
        slot = np.zeros(len(active), np.int64)
        slot[touched] = np.arange(len(touched))
        most = min(width, int(many.max()))
        extra_s = np.full((len(touched), most), -2.0, similar.dtype)
        extra_i = np.full((len(touched), most), -1, ids.dtype)
        extra_s[slot[owner], rank], extra_i[slot[owner], rank] = value, fresh
        which = active[touched]
        all_s, all_i = np.concatenate((similar[which], extra_s), 1), np.concatenate((ids[which], extra_i), 1)
        all_d = np.concatenate((done[which], extra_i < 0), 1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        similar[which] = np.take_along_axis(all_s, order, 1)
        ids[which] = np.take_along_axis(all_i, order, 1)
        done[which] = np.take_along_axis(all_d, order, 1)
    return similar, ids


def _choose(vectors: np.ndarray, similar: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """``keep`` candidates per row: first those nearer to the row than to any chosen one, then the nearest others."""
    if ids.shape[1] <= keep:
        return np.pad(ids, ((0, 0), (0, keep - ids.shape[1])), constant_values=-1)
    among = vectors[ids]
    between = np.matmul(among, among.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        hidden = ((between[:, c, :] > similar[:, c, None]) & chosen).any(1)
        chosen[:, c] = ~hidden & (ids[:, c] >= 0) & (chosen.sum(1) < keep)
    score = np.where(ids < 0, -9.0, similar) + np.where(chosen, 4.0, 0.0)
    order = np.argsort(-score, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1)


def _insert(
    vectors: np.ndarray, links: np.ndarray, new: np.ndarray, similar: np.ndarray, ids: np.ndarray
) -> None:
    """Link the nodes ``new`` to their best candidates, and these back to them."""
    width = links.shape[1]
    links[new] = _choose(vectors, similar, ids, width)
    source, target = np.repeat(new, width), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    value = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-value, target))
    source, target = source[order], target[order]
    heads, first, many = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, many)
    near = rank < width
    back = np.full((len(heads), int(min(many.max(initial=0), width))), -1, links.dtype)
    back[np.repeat(np.arange(len(heads)), many)[near], rank[near]] = source[near]
    doubled = (back[:, :, None] == links[heads][:, None, :]).any(2)
    back[doubled] = -1
    for low in range(0, len(heads), 1024):
        some = heads[low : low + 1024]
        all_ids = np.concatenate((links[some], back[low : low + 1024]), 1)
        full = (all_ids >= 0).sum(1) > width
        similar = np.einsum("qd,qed->qe", vectors[some], vectors[all_ids])
        similar[all_ids < 0] = -2.0
        similar, all_ids = _top(similar, all_ids, all_ids.shape[1])
        links[some[~full]] = all_ids[~full][:, :width]
        if full.any():
            links[some[full]] = _choose(vectors, similar[full], all_ids[full], width)


def _level(vectors: np.ndarray, n_known: int, fresh: np.ndarray, above: list[np.ndarray], width: int, settings: GraphSettings, cosine: float, owner: np.ndarray, nodes: list[int]) -> np.ndarray:
    """Links of one level over the nodes known so far and the ``fresh`` rows, which join balls or become nodes.

    ``vectors`` are those of all rows. Nodes are numbered in ``nodes``.
    """
    links = np.full((n_known + len(fresh), width), -1, np.int32)
    placed = np.zeros((n_known + len(fresh), vectors.shape[1]), vectors.dtype)
    placed[:n_known] = vectors[nodes]
    waiting = [np.arange(a, min(a + settings.batch, n_known)) for a in range(0, n_known, settings.batch)]
    size = 0
    for batch in waiting:
        similar, ids = _candidates(placed, links, size, placed[batch], above, settings, width)
        similar, ids = _with_batch(similar, ids, placed[batch], batch)
        _insert(placed, links, batch, similar, ids)
        size += len(batch)
    for low in range(0, len(fresh), settings.batch):
        rows = fresh[low : low + settings.batch]
        x = vectors[rows]
        similar, ids = _candidates(placed, links, size, x, above, settings, width)
        joined = similar[:, 0] >= cosine if similar.shape[1] else np.zeros(len(rows), bool)
        if joined.any():
            owner[rows[joined]] = ids[joined, 0]
        within = x @ x.T
        close = np.tril(within >= cosine, -1)
        stays = ~joined
        for i in np.flatnonzero(close.any(1) & ~joined):
            near = np.flatnonzero(close[i] & stays)
            if len(near):
                stays[i] = False
                owner[rows[i]] = size + int(stays[: near[within[i, near].argmax()]].sum())
        rows, x, similar, ids = rows[stays], x[stays], similar[stays], ids[stays]
        if not len(rows):
            continue
        batch = np.arange(size, size + len(rows))
        owner[rows], placed[batch] = batch, x
        nodes.extend(rows.tolist())
        similar, ids = _with_batch(similar, ids, x, batch)
        _insert(placed, links, batch, similar, ids)
        size += len(rows)
    return links[:size]


def _candidates(placed: np.ndarray, links: np.ndarray, size: int, x: np.ndarray, above: list[np.ndarray], settings: GraphSettings, width: int) -> tuple[np.ndarray, np.ndarray]:
    beam = max(settings.beam, width)
    if size <= beam:
        return _top(x @ placed[:size].T, np.tile(np.arange(size, dtype=np.int32), (len(x), 1)), beam)
    entry = descend(placed, above, x, size)
    return beam_search(placed[:size], links[:size], x, entry, beam)


def _with_batch(similar: np.ndarray, ids: np.ndarray, x: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    within = x @ x.T
    np.fill_diagonal(within, -2.0)
    keep = min(len(batch), 32)
    near, at = _top(within, np.tile(batch.astype(np.int32), (len(batch), 1)), keep)
    at = np.where(near <= -2.0, -1, at)
    return _top(np.concatenate((similar, near), 1), np.concatenate((ids, at), 1), similar.shape[1] + keep)


def descend(vectors: np.ndarray, above: list[np.ndarray], queries: np.ndarray, size: int | None = None) -> np.ndarray:
    """Entry nodes of each query: the best few nodes met on the way down the levels ``above``, top first."""
    n = len(queries)
    entry = np.zeros((n, 1), np.int32)
    for links in above:
        if size is not None and len(links) > size:
            links = np.where(links[:size] < size, links[:size], -1)
        _, entry = beam_search(vectors[: len(links)], links, queries, entry, 4)
    return entry


def build(vectors: np.ndarray, keys: np.ndarray, radius: float, settings: GraphSettings = GraphSettings()) -> Graph:
    """The graph of unit ``vectors`` (float32, in the order of ``keys``, 64-bit hashes that pick the levels)."""
    n = len(vectors)
    uniform = (keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2**53
    level = np.floor(-np.log(np.maximum(uniform, 1e-300)) / np.log(settings.links)).astype(int)
    owner, nodes, above = np.full(n, -1, np.int32), [], []
    cosine = np.cos(radius)
    for at in range(int(level.max(initial=0)), -1, -1):
        fresh = np.flatnonzero(level == at)
        width = settings.links * (1 if at else 2)
        above.append(_level(vectors, len(nodes), fresh, above, width, settings, cosine, owner, nodes))
    return Graph(vectors, np.array(nodes, np.int64), above[::-1], owner)


def search(graph: Graph, queries: np.ndarray, reach: np.ndarray, beam: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, node, similarity)`` of the nodes found with similarity of at least ``reach`` (one per query).

    A beam full of such nodes may hide more of them, so it is doubled for these queries until it is not.
    Queries whose beam would take in a quarter of the graph are compared with all of it.
    """
    vectors = graph.vectors[graph.nodes]
    ground, above = graph.levels[0], graph.levels[:0:-1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = np.arange(len(queries))
    while len(todo):
        again = []
        if beam * 4 >= len(ground):
            for low in range(0, len(todo), batch):
                some = todo[low : low + batch]
                similar = queries[some] @ vectors.T
                row, ids = np.nonzero(similar >= reach[some, None])
                found.append((some[row], ids, similar[row, ids]))
            break
        step = max(16, min(batch, 40_000_000 // max(1, len(ground)), 4_000_000 // beam))
        for low in range(0, len(todo), step):
            some = todo[low : low + step]
            entry = descend(vectors, above, queries[some])
            similar, ids = beam_search(vectors, ground, queries[some], entry, beam)
            inside = (similar >= reach[some, None]) & (ids >= 0)
            full = inside[:, -1]
            again.append(some[full])
            row, place = np.nonzero(inside & ~full[:, None])
            found.append((some[row], ids[row, place], similar[row, place]))
        todo, beam = np.concatenate(again), beam * 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))
