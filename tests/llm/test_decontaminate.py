"""Benchmark passages against a search of every window."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexifold.llm import decontaminate

from .conftest import EDGE


def words(text):
    return [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]


def shingles(w, k):
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs, items):
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            if not x or not w:
                continue
            k = min(5, len(x))
            for start in range(max(1, len(w) - len(x) + 1)):
                s = jaccard(shingles(w[start : start + len(x)], k), shingles(x, k))
                if s >= 0.8:
                    found[(d, i)] = max(found.get((d, i), 0), s)
    return {(str(d), i): round(s, 9) for (d, i), s in found.items()}


def text_of(seed, n):
    random = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in random.integers(0, 400, n))


def edited(item, kind):
    w = item.split()
    if kind == 1:
        w[-1] = "other"
    elif kind == 2:
        w[0], w[-1] = "new", "old"
    elif kind == 3:
        w = w[2:]
    elif kind == 4:
        w.insert(len(w) - 2, "inserted")
    elif kind == 5:
        w[len(w) // 2] = "middle"
    elif kind == 6:
        w = [x.upper() for x in w]
    elif kind == 7:
        w = w[: len(w) // 2]
    return " ".join(w)


@pytest.fixture(scope="module")
def items():
    return [(i, text_of(i, 12 + 3 * i)) for i in range(10)] + [(90, "a b"), (91, ""), (92, None), (93, "same " * 20)]


@pytest.fixture(scope="module")
def docs(items):
    rows = [(i, text_of(100 + i, 150)) for i in range(20)]
    for i, (_, item) in enumerate(items[:10]):
        for kind in range(8):
            rows.append((200 + 10 * i + kind, f"{text_of(300 + i, 40)}\n{edited(item, kind)} {text_of(400 + kind, 30)}"))
    rows += [(900, items[3][1]), (901, items[4][1] + " " + items[5][1]), (902, "x a b y"), (903, "a"), (904, "same " * 30)]
    rows += [(None, items[6][1]), (None, None), (905, ""), (906, items[2][1]), (906, items[2][1]), (906, "clean")]
    return rows


@pytest.mark.parametrize("broadcast_rows", [500_000, -1])
def test_equals_the_search_of_every_window(spark, docs, items, broadcast_rows):
    table = spark.createDataFrame([(*d, "own", "own") for d in docs], "doc_id long, text string, words string, text_hash string")
    bench = spark.createDataFrame([(*i, "own") for i in items], "item_id long, text string, size string")
    found = decontaminate.contaminated(table, bench, decontaminate.Contract(broadcast_rows=broadcast_rows)).collect()
    assert {(str(r["doc_id"]), r["item_id"]): round(r["similarity"], 9) for r in found} == brute(docs, items)
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})
    assert all(r["bit_distance"] <= 19 for r in found)
    left = decontaminate.without_contaminated(table, bench)
    assert left.columns == table.columns
    dirty = {d for d, _ in brute(docs, items)}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in docs if str(d) not in dirty)


def test_finds_passages_in_another_order(spark):
    parts = [text_of(500 + i, 30) for i in range(4)]
    items = [(1, " ".join(parts[:2])), (2, " ".join(parts[2:])), (3, " ".join([*parts[1:3], text_of(510, 9)]))]
    around = [text_of(600 + i, 50) for i in range(6)]
    docs = [
        (1, f"{around[0]} {parts[1]} {parts[0]} {around[1]}"),
        (2, f"{parts[3]} {parts[2]} {around[2]}"),
        (3, f"{around[3]} {text_of(510, 9)} {parts[2]} {parts[1]}"),
        (4, f"{parts[1]} {parts[0]}"),
        (5, f"{around[4]} {parts[1]} {parts[3]} {around[5]}"),
        (6, f"{parts[1]} {around[0]} {parts[0]}"),
        (7, " ".join(f"{parts[1]} {parts[0]}".split()[:-2])),
    ]
    expected = brute(docs, items)
    assert {("1", 1), ("2", 2), ("4", 1)} <= set(expected)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(table, bench).collect()
    assert {(str(r["doc_id"]), r["item_id"]): round(r["similarity"], 9) for r in found} == expected
    for r in found:
        w, x = words(dict(docs)[r["doc_id"]]), words(dict(items)[r["item_id"]])
        cut = w[r["start_word"] : r["start_word"] + r["window_words"]]
        assert round(jaccard(shingles(cut, 5), shingles(x, 5)), 9) == round(r["similarity"], 9)


def test_covering_starts_equal_a_count_at_every_start(spark):
    random = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        last, window = int(random.integers(0, 40)), int(random.integers(1, 12))
        at = sorted({int(x) for x in random.integers(0, last + window, random.integers(0, 40))})
        rows.append((at, window, int(random.integers(1, window + 1)), last))
    frame = spark.createDataFrame(rows, "at array<int>, window int, need int, last int")
    found = frame.select(decontaminate._covering_starts(*map(F.col, ("at", "window", "need", "last"))).alias("s")).collect()
    for (at, window, need, last), r in zip(rows, found, strict=True):
        assert r["s"] == [s for s in range(last + 1) if sum(s <= p < s + window for p in at) >= need]


def test_repeats_do_not_hide_a_similar_window(spark):
    items = [(i, f"{text_of(700 + i, 140)} {f'x{i} ' * 16}") for i in range(8)]
    docs = [(i, f"{text_of(800, 20)} {text_of(700 + i, 140)} {f'y{i} ' * 16} {text_of(801, 20)}") for i in range(8)]
    expected = brute(docs, items)
    assert len(expected) == 8 and max(expected.values()) < 0.83
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(table, bench).collect()
    assert {(str(r["doc_id"]), r["item_id"]): round(r["similarity"], 9) for r in found} == expected


def test_numbered_repeats(spark):
    frame = spark.createDataFrame([(["a", "b", "a", "a"],), (["a", "b"],), ([],)], "x array<string>")
    found = [r["s"] for r in frame.select(decontaminate.numbered(F.col("x")).alias("s")).collect()]
    assert found == [["a", "b", "a 1", "a 2"], ["a", "b"], []]


def test_empty_tables(spark, edge, nothing, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(edge, bench.limit(0)).count() == 0
    assert decontaminate.without_contaminated(edge, bench.limit(0)).count() == len(EDGE)


def test_blocks_cover_all_bits_and_share_one_within_the_radius(spark):
    random = np.random.default_rng(0)
    rows = []
    for n in range(200):
        a = int(random.integers(0, 2**63))
        b = a
        for bit in random.choice(64, 19, replace=False):
            b ^= 1 << int(bit)
        rows.append((n, a, b - 2**64 if b >= 2**63 else b))
    table = spark.createDataFrame(rows, "n int, a long, b long")
    left = table.select("n", decontaminate._block_values("a", 19).alias("x"))
    right = table.select("n", decontaminate._block_values("b", 19).alias("x"))
    assert left.join(right, ["n", "x"]).select("n").distinct().count() == 200
    assert left.count() == 20 * 200


def test_simhash_and_similarity(spark):
    frame = spark.createDataFrame([(["a", "b", "b"], ["b", "b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    rows = frame.select(decontaminate.simhash(F.col("x")).alias("h"), decontaminate.weighted_jaccard(F.col("x"), F.col("y")).alias("s")).collect()
    one = spark.sql("select xxhash64('b') h").first()["h"]
    assert rows[0]["h"] == one and rows[0]["s"] == 0.5 and rows[1]["h"] == 0 and rows[1]["s"] == 0


def test_windows_are_not_moved_with_their_shingles(spark, monkeypatch):
    from tests.conftest import plan_of

    written = {}
    keep = decontaminate.materialise

    def kept(df, name):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(decontaminate, "materialise", kept)
    docs = spark.createDataFrame([(1, text_of(1, 40))], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, text_of(1, 20))], "item_id long, text string"))
    assert "array<string>" not in {kind for name in ("window_texts", "window_prints") for _, kind in written[name].dtypes}
    plan = plan_of(found)
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2
