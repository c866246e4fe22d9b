"""Exact and near duplicates against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexifold.llm import exact_dedup, near_dedup

from .conftest import EDGE

FOLD = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())


def normal(text):
    return (text or "").translate(FOLD)


def groups_of(rows):
    found = {}
    for i, text in rows:
        found.setdefault(normal(text), []).append(i)
    return found


def check_exact(found, rows):
    groups = groups_of(rows)
    expected = []
    for i, text in rows:
        ids = [x for x in groups[normal(text)] if x is not None]
        digest = hashlib.sha256(normal(text).encode()).hexdigest()
        expected.append((str(i), str(max(ids) if ids else None), len(groups[normal(text)]), digest))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == sorted(expected)
    assert sum(r["kept"] for r in found) == len(groups)
    for r in found:
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_exact_on_edge_rows(edge, nothing):
    check_exact(exact_dedup.exact_duplicates(edge).collect(), [(r[0], r[1]) for r in EDGE])
    assert exact_dedup.exact_duplicates(nothing).count() == 0


@pytest.mark.parametrize("chunk_hash", [F.octet_length, lambda c: F.lit(1).cast("long")])
def test_exact_verifies_chunks_whose_hashes_clash(spark, chunk_hash):
    rows = [(i, t * 30) for i, t in enumerate(["one two. ", "two one. ", "one two. ", "six ten. ", "ten six. ", "TWO one. "])]
    rows += [(10, ""), (11, None), (12, "ab"), (13, "ba"), (14, "ab"), (14, "ab"), (14, "ba")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_duplicates(docs, exact_dedup.Chunking(20, 60), lambda c: chunk_hash(c).cast("long"))
    check_exact(found.collect(), rows)


def test_exact_beyond_the_broadcast_bound(spark, monkeypatch):
    from lexifold.llm import common

    monkeypatch.setattr(common.JoinBound, "__init__", lambda self: [object.__setattr__(self, k, v) for k, v in (("bytes", 0), ("hot_share", 3), ("salts", 4))] and None)
    rows = [(i, "hot text" if i % 2 else f"text {i // 4}") for i in range(60)]
    check_exact(exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_chunks_cover_the_text(spark):
    text = "first. second, third\nfourth " * 40 + "x" * 9000
    row = spark.createDataFrame([(text,)], "t string").select(exact_dedup.Chunking().chunks(F.col("t")).alias("c")).first()
    assert "".join(row["c"]) == text and max(map(len, row["c"])) <= 4002 and len(row["c"]) > 2


def test_exact_stage_keeps_one_of_each(edge, nothing):
    kept = exact_dedup.keep_one_of_each(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert len(rows) == len(groups_of([(r[0], r[1]) for r in EDGE]))
    assert {normal(r["text"]) for r in rows} == {normal(r[1]) for r in EDGE}
    assert {r["doc_id"] for r in rows} >= {2, 5, 8, 10} and 1 not in {r["doc_id"] for r in rows}
    assert exact_dedup.keep_one_of_each(nothing).count() == 0


def test_exact_stage_with_distinct_ids(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (None, "b"), (3, None), (4, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in exact_dedup.keep_one_of_each(docs).collect()} == {2, None, 4}


# ---- near ---------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", normal(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def brute_components(rows, k=3, threshold=2):
    prints = [brute_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= threshold:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted((str(i), f"{prints[a]:016x}", str(least.get(find(a)))) for a, (i, _) in enumerate(rows))


def test_near_on_edge_rows(edge, nothing):
    found = near_dedup.near_duplicates(edge).collect()
    rows = [(r[0], r[1]) for r in EDGE]
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == brute_components(rows)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_finds_edited_copies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base.replace(f"w{10 + i}", "changed", 1) if i else base) for i in range(25)]
    rows += [(100 + i, " ".join(f"v{i}x{j}" for j in range(50))) for i in range(20)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_components(rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == expected
    assert len({r["component_id"] for r in found}) < 45


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.integers(0, 2), st.integers(1, 2), st.randoms())
def test_home_is_among_the_anchors_of_all_within_the_threshold(values, threshold, blocks, random):
    near = []
    for v in values:
        for b in random.sample(range(64), threshold):
            v ^= 1 << b
        near.append(v)
    rows, keys, homes = near_dedup.anchors(np.array(values, np.uint64), threshold, blocks)
    home = {int(r): int(k) for r, k, h in zip(rows, keys, homes, strict=True) if h}
    assert len(home) == len(values) == int(homes.sum())
    rows, keys, _ = near_dedup.anchors(np.array(near, np.uint64), threshold, blocks)
    reach = {(int(r), int(k)) for r, k in zip(rows, keys, strict=True)}
    assert len(reach) == len(rows)
    assert all((i, home[i]) in reach for i in range(len(values)))


def test_links_equal_brute_force(spark):
    random = np.random.default_rng(3)
    values = {int(v) for v in random.integers(0, 2**63, 60)}
    for v in list(values):
        for bits in ([1], [63], [5, 40], [22, 23], [46, 60], [1, 2, 3]):
            values.add(v ^ sum(1 << b for b in bits))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    expected = {
        (min(a, b), max(a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    }
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    for blocks in (1, 2):
        assert {(r["a"], r["b"]) for r in near_dedup.links(prints, 2, blocks).collect()} == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)]
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(20)}


def test_near_stage(edge):
    kept = near_dedup.keep_one_of_each(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(None) == 2 and 4 not in ids


def test_replicas_are_not_broadcast(spark):
    from lexifold.llm.common import materialise
    from tests.conftest import plan_of

    prints = materialise(spark.range(2000).select(F.xxhash64("id").alias("fp")), "prints")
    plan = plan_of(near_dedup.links(prints))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
