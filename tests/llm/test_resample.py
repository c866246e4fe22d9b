"""The draw against brute force, and rows that are hard to treat."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexifold.llm import resample as R


def brute(docs, target, settings):
    def buckets(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(w[i : i + n]) for n in range(1, settings.runs + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % settings.buckets for r in runs]

    own, aim = [buckets(t) for _, t in docs], [buckets(t) for t in target]
    s, t = [0] * settings.buckets, [0] * settings.buckets
    for counts, found in ((s, own), (t, aim)):
        for _, each in found:
            for b in each:
                counts[b] += 1
    n = settings.buckets
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + n) / ((a + 1) * (sum(t) + n)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for (doc, _), (many, each) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in each) // len(each) if each else 0
        h = int(hashlib.sha256(f"{settings.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(each), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), many])
    ready = sorted((r for r in rows if r[4] >= settings.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = [(tuple(r[:4]), i + 1) for i, r in enumerate(ready[: len(ready) * settings.percent // 100])]
    out = [(*key, rank) for key, rank in ranks]
    rest = [tuple(r[:4]) for r in rows]
    for key, _ in ranks:
        rest.remove(key)
    return sorted([*out, *[(*r, None) for r in rest]], key=str)


def some_docs(rng, n, words=60):
    pool = ["alpha", "Beta", "gamma", "É", "東京", "x9", "delta-7", "Omega"] + [f"w{i}" for i in range(80)]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, words)))) for i in range(n)]


@pytest.mark.parametrize(
    "settings",
    [R.DrawSettings(), R.DrawSettings(runs=3, buckets=50, percent=50), R.DrawSettings(percent=0), R.DrawSettings(percent=100, least_words=0)],
)
def test_draw_equals_brute_force(spark, settings):
    rng = random.Random(4)
    docs, target = some_docs(rng, 200), [t for _, t in some_docs(rng, 20)]
    found = R.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
        spark.createDataFrame([(t,) for t in target], "text string"), settings,
    )
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, target, settings)


def test_odd_rows_and_ties(spark, edge, nothing):
    items = edge.select("text", F.lit("x").alias("doc_id"))
    settings = R.DrawSettings(least_words=0, percent=60)
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    found = sorted(map(tuple, R.resample(edge, items, settings).collect()), key=str)
    assert found == brute(docs, [t for _, t in docs], settings)
    assert R.resample(nothing, items).count() == 0
    assert {r["weight"] for r in R.resample(edge, items.limit(0)).collect() if not r["n_features"]} == {0}
    same = spark.createDataFrame([(None, "a b")] * 4 + [(5, "a b")] * 6, "doc_id long, text string")
    for percent in (10, 50, 70, 90):
        ranks = [r["rank"] for r in R.resample(same, items, R.DrawSettings(least_words=1, percent=percent)).collect()]
        assert sorted(r for r in ranks if r) == list(range(1, percent // 10 + 1))


def test_cutoff_of_keys_with_many_ties(spark):
    rng = random.Random(9)
    for kind, make in (("long", lambda: rng.randint(-5, 5)), ("long", lambda: rng.randint(-(10**12), 10**12)), ("string", lambda: rng.choice("abcXYZé"))):
        keys = [make() for _ in range(500)]
        table = spark.createDataFrame([(k,) for k in keys], f"key {kind}").repartition(5).cache()
        ordered = sorted(keys)
        for k in (1, 2, 250, 499, 500):
            value, smaller = R.kth(table, "key", k)
            assert value == ordered[k - 1] and smaller == ordered.index(value)
        with pytest.raises(ValueError, match="fewer"):
            R.kth(table, "key", 501)


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "one two three " * 8) for i in range(40)], "doc_id string, text string")
    found = R.resample(docs, docs.select("text"))
    assert sorted(r["rank"] for r in found.collect() if r["rank"]) == [1, 2, 3, 4]
