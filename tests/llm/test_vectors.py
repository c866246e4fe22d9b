"""Vector operators against brute force, and rows that are hard to treat."""

import hashlib
import random

import numpy as np
import pytest

from lexifold.llm import vector_codes as VC
from lexifold.llm import vector_dedup as VD
from lexifold.llm import vector_graphs as VG

CLASH = "key string, v string, n string, owner string, node string, code string, error string"


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label int{extra}")


def planted(n=300, width=16, seed=3):
    """Single vectors, pairs, a group of near copies around one direction, a chain, and exact copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    group = rng.normal(size=width) + rng.normal(size=(150, width)) * 0.12
    pairs = base[:20] * 3.0 + rng.normal(size=(20, width)) * 0.05
    angles = np.arange(12) * 0.25
    chain = np.outer(np.cos(angles), np.eye(width)[0]) + np.outer(np.sin(angles), np.eye(width)[1])
    return np.concatenate([base, group, pairs, chain, base[50:60], base[50:51]]).astype(np.float32)


def brute_links(x, threshold=0.95):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (least == label).all():
            return near.sum(1), label
        label = least


@pytest.fixture(scope="module")
def linked(spark):
    x = planted()
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    found, audits = VD.near_duplicate_vectors(table(spark, rows), VD.LinkSettings(shard_rows=100, audited=64))
    return x, found.toPandas().set_index("vec_id").sort_index(), audits.toPandas()


def test_links_equal_brute_force(linked):
    x, found, audits = linked
    many, label = brute_links(x)
    assert many.max() > 100 and len(np.unique(label)) < len(x) - 150
    assert found["n_links"].tolist() == many.tolist()
    assert found["component_id"].tolist() == label.tolist()
    assert found["kept"].tolist() == (label == np.arange(len(x))).tolist()
    assert audits["found"].sum() >= 0.995 * audits["audited"].sum() and len(audits) == 8 * 9 // 2


def test_rows_without_a_direction_link_with_nothing(spark):
    one, nan, inf = [1.0, 2.0, 3.0, 4.0], [1.0, float("nan"), 0.0, 0.0], [1.0, float("inf"), 0.0, 0.0]
    rows = [
        (7, one, 1), (3, [2.0, 4.0, 6.0, 8.0], None), (9, None, 1), (10, nan, 1), (11, inf, 1), (12, [0.0] * 4, 1),
        (13, [1.0, None, 0.0, 0.0], 1), (None, one, 2), (None, [-1.0, 0.0, 0.0, 0.0], 2), (5, one, 1), (5, one, 1),
        (14, [1e-30, 2e-30, 3e-30, 4e-30], 0), (15, [-0.0] * 4, 0),
    ]
    clashing = table(spark, [(*r, *"abcdefg") for r in rows], f", {CLASH}")
    found = VD.near_duplicate_vectors(clashing)[0].collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found)
    alike = [(3, 5, 3, True), (5, 5, 3, False), (5, 5, 3, False), (7, 5, 3, False), (14, 5, 3, False), (0, 5, 3, False)]
    apart = [(i, 0, i, True) for i in (9, 10, 11, 12, 13, 15)] + [(0, 0, 0, True)]
    assert got == sorted(alike + apart)
    assert VD.near_duplicate_vectors(clashing.limit(0))[0].count() == 0
    assert VD.near_duplicate_vectors(clashing.filter("vec_id in (9, 10)"))[0].count() == 2
    with pytest.raises(ValueError, match="one length"):
        VD.near_duplicate_vectors(table(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]))


@pytest.mark.parametrize("n", [0, 1, 2, 40, 700])
def test_graph_finds_what_is_within_reach(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, 12)) * 0.3
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if n else x.astype(np.float32)
    graph = VG.build(x, rng.integers(0, 2**63, n).astype(np.uint64), 0.1)
    assert n == 0 or (graph.owner >= 0).all()
    if not n:
        return
    nodes = x[graph.nodes]
    assert np.einsum("ij,ij->i", x, nodes[graph.owner]).min() >= np.cos(0.1) - 1e-6
    row, node, _ = VG.search(graph, x, np.full(n, 0.8, np.float32), 32)
    true = x @ nodes.T >= 0.8
    assert len(row) == len({*zip(row.tolist(), node.tolist(), strict=True)})
    assert true[row, node].sum() >= 0.99 * true.sum()


def test_beams_widen_until_the_audit_passes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = VG.build(x, rng.integers(0, 2**63, 600).astype(np.uint64), 0.0)
    graph.levels[0][:, 2:] = -1
    settings = VD.LinkSettings(beam=2, audited=600)
    beam, true, found = VD.wide_enough(graph, x, np.full(600, 0.9, np.float32), settings)
    assert beam > 2 and found >= settings.recall * true


def test_forest_joins_what_is_linked():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(1, 30)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 25))]
        least = list(range(n))
        for _ in range(n):
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        half = len(edges) // 2
        labels = np.arange(n)
        for part in (edges[:half], edges[half:]):
            labels = VD.forest(labels, np.array([a for a, _ in part], int), np.array([b for _, b in part], int))
        assert labels.tolist() == least


# ---- codes ------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, lab, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v, lab in rows]
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: kept[r][0])[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[assign(p, c[p])[1]].append(c[p])
            books[p] = [[sum(z) // len(o) for z in zip(*o, strict=True)] if o else books[p][e] for e, o in enumerate(own)]
    found = [[assign(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, lab, _), e in zip(kept, errors, strict=True):
        totals[lab] = totals.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {(i, "".join(f"{e:02x}" for _, e in f), err, totals[lab]) for (i, lab, _), f, err in zip(kept, found, errors, strict=True)}, digest


@pytest.mark.parametrize(("entries", "rounds"), [(256, 4), (5, 3), (3, 0)])
def test_codes_equal_brute_force(spark, entries, rounds):
    rng = np.random.default_rng(entries)
    x = np.round(rng.normal(size=(90, 8)), 1).astype(np.float32)
    rows = [(1000 - i, v.tolist(), None if i % 4 == 0 else i % 3) for i, v in enumerate(x)]
    settings = VC.CodeSettings(entries=entries, rounds=rounds)
    coded, books = VC.compress(table(spark, rows), settings)
    expected, digest = brute_codes(rows, 4, entries, rounds)
    assert {tuple(r) for r in coded.collect()} == expected and VC.books_digest(books) == digest


def test_nearest_takes_the_lower_index_of_a_tie():
    rng = np.random.default_rng(0)
    for width in (1, 3, 16):
        book, x = rng.integers(-4, 5, (64, width)), rng.integers(-6, 7, (500, width))
        index, best = VC.nearest(x, book)
        distance = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()


def test_codes_of_odd_rows(spark):
    rows = [
        (5, [0.5, -0.25, 1.0, 0.0], 1), (5, [0.5, -0.25, 1.0, 0.0], 1), (None, [0.1, 0.2, 0.3, 0.4], None), (1, None, 1),
        (2, [float("nan"), 0.0, 0.0, 0.0], 1), (3, [None, 0.0, 0.0, 0.0], None), (4, [-float("inf"), 0.0, 0.0, 0.0], 1),
    ]
    clashing = table(spark, [(*r, *"abcdefg") for r in rows], f", {CLASH}")
    coded, books = VC.compress(clashing)
    got = sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in coded.collect())
    assert got == [(0, "02020202", 0, 0), (5, "00000000", 0, 0), (5, "00000000", 0, 0)]
    assert books.shape == (4, 3, 1) and VC.decode(np.array([[0, 0, 0, 0]]), books).tolist() == [[512, -256, 1024, 0]]
    assert VC.compress(clashing.limit(0))[0].count() == 0
    for bad in ([(1, [1.0, 2.0, 3.0], 0)], [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]):
        with pytest.raises(ValueError, match="one length"):
            VC.compress(table(spark, bad))
