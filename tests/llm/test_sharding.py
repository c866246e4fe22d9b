"""Shards by bytes, written shards, and salted joins."""

import zlib

import pytest
from pyspark.sql import functions as F

from lexifold.llm import sharding
from lexifold.llm.common import JoinBound, drop_documents, join_groups

from .conftest import EDGE


@pytest.mark.parametrize("shards, partitions", [(1, 1), (4, 3), (16, 7)])
def test_shards_are_contiguous_and_balanced(edge, nothing, shards, partitions):
    rows = sharding.shard_documents(edge, shards, partitions).collect()
    expected = sorted(
        (-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in EDGE
    )
    total, start, slots = sum(s for *_, s in expected), 0, {}
    places = []
    for i, crc, size in expected:
        shard = start * shards // total
        places.append((i, crc, size, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        start += size
    found = [(-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in rows]
    assert sorted(found) == sorted(places)
    assert sharding.shard_documents(nothing, shards).count() == 0


def test_written_shards_hold_whole_rows(edge, tmp_path):
    back = sharding.write_shards(edge, str(tmp_path / "shards"), 4)
    assert back.count() == len(EDGE)
    placed = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_documents(edge, 4).collect()}
    for r in back.collect():
        key = (r["doc_id"], zlib.crc32((r["text"] or "").encode()))
        assert r["shard_"] == placed[key] and r["shard"] == "own shard"


@pytest.mark.parametrize("bound", [JoinBound(), JoinBound(bytes=0), JoinBound(bytes=0, hot_share=3, salts=5)])
def test_join_groups_loses_nothing(spark, bound):
    facts = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"))
    groups = facts.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows = join_groups(facts, groups, ["g"], "n", "doc_id", bound=bound).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300)) and all(r["n"] == (100 if r["g"] == 0 else 1) for r in rows)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_drop_documents(spark, edge, bound):
    gone = spark.createDataFrame([(1,), (None,), (99,)], "doc_id long")
    left = drop_documents(edge, gone, bound)
    assert left.columns == edge.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, *_ in EDGE if i not in (1, None))
