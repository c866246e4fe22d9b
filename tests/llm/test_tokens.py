"""Ids against the library, packing, counts and codes against the ids."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexifold.llm import packing, token_codes, token_counts
from lexifold.llm.tokens import Encoder, crc32, public_path

from .conftest import EDGE

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ENCODERS = {name: Encoder(public_path(name)) for name in FILES}
TEXT = st.text(st.sampled_from(list("abAB'sdtéÉßñЖ東1 2.,!\n\t\r  \x1ćİ<|endoftext|>")), max_size=60)


def ids_of(name, text):
    return ENCODERS[name].tokenizer.encode(text or "", add_special_tokens=False).ids


def test_styles_are_recognised():
    assert [ENCODERS[n].style for n in FILES] == ["word", "space"]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_ids_equal_the_library(name, texts):
    ids, starts = ENCODERS[name].encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == ids_of(name, text)


def test_empty_batch():
    ids, starts = ENCODERS[FILES[0]].encode(pa.array([], pa.string()))
    assert len(ids) == 0 and starts.tolist() == [0]


def test_counts_equal_the_library(spark, edge, nothing):
    found = token_counts.count_tokens(edge, public_path(FILES[0]), limit=100).collect()
    expected = sorted(
        (str(i), len((t or "").encode()), len(ids_of(FILES[0], t)), len(ids_of(FILES[0], t)) > 100) for i, t, *_ in EDGE
    )
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == expected
    assert token_counts.count_tokens(nothing, public_path(FILES[0])).count() == 0


def test_counts_do_not_depend_on_the_broadcast(edge):
    from lexifold.operators.lookup import BroadcastBound

    whole = token_counts.count_tokens(edge, public_path(FILES[0]))
    little = token_counts.count_tokens(edge, public_path(FILES[0]), bound=BroadcastBound(50, 10_000))
    assert sorted(map(str, whole.collect())) == sorted(map(str, little.collect()))


def test_counts_refuse_a_tokeniser_that_keeps_blanks(edge):
    with pytest.raises(Exception, match="white space"):
        token_counts.count_tokens(edge, public_path(FILES[1])).collect()


@pytest.mark.parametrize("rows", [0, 1, 3, 1000])
def test_counts_of_frequent_and_rare_words_equal_the_library(spark, rows):
    from lexifold.operators.lookup import BroadcastBound

    texts = [
        "tree tree tree Unbelievableness", "zyzzyva zyzzyva Zyzzyva\ttree", "tree", "", None, " \n ", "tree", "tree",
        "\x1ctree\u3000Zyzzyva don't\xa0\x0b\x0c\rtree", "qwrtzpsdfg " * 300,
    ]
    docs = [(None if i == 2 else i // 2, t) for i, t in enumerate(texts)] * 2
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = token_counts.count_tokens(table, public_path(FILES[0]), limit=3, bound=BroadcastBound(rows, 10_000)).collect()
    tokens = [(str(i), len((t or "").encode()), len(ids_of(FILES[0], t))) for i, t in docs]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == sorted(tokens)
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in found)


@pytest.mark.parametrize("rows", [0, 1000])
def test_counts_of_bytes_that_are_no_text(spark, rows):
    from lexifold.operators.lookup import BroadcastBound

    table = spark.sql("SELECT 1L AS doc_id, CAST(X'746572FF6D20C3E282' AS STRING) AS text")
    found = token_counts.count_tokens(table, public_path(FILES[0]), bound=BroadcastBound(rows, 10_000)).first()
    assert (found["n_bytes"], found["n_tokens"]) == (9, len(ids_of(FILES[0], "ter\ufffdm \ufffd\ufffd")))


def test_counts_read_the_texts_twice_in_all(edge, spark):
    from pyspark.sql import functions as F

    from lexifold.operators.lookup import BroadcastBound

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = edge.select("doc_id", seen("text").alias("text"))
    token_counts.count_tokens(docs, public_path(FILES[0]), bound=BroadcastBound(50, 10_000)).collect()
    assert read.value == 2 * len(EDGE)


# ---- codes --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), min_size=1, max_size=5))
def test_codes_round_trip_and_any_single_id(docs):
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    flat = np.array([i for d in docs for i in d], np.uint32)
    payload = token_codes.pack_segment(np.arange(len(docs)), np.zeros(len(docs), bool), starts, 7, flat)
    segment = token_codes.open_segment(payload)
    assert segment.first_id == 7 and segment.starts.tolist() == starts.tolist()
    assert segment.ids(0, len(flat)).tolist() == flat.tolist()
    for k, d in enumerate(docs):
        assert segment.ids(int(starts[k]), int(starts[k + 1])).tolist() == d
    for at in range(0, len(flat), max(1, len(flat) // 50)):
        assert segment.id_at(at) == flat[at]


def test_code_files_equal_the_library(spark, edge, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT_IDS", 5_000)
    token_codes.write_codes(edge, str(tmp_path / "codes"), public_path(FILES[0]), end_id=2, partitions=3)
    found = token_codes.read_documents(spark, str(tmp_path / "codes")).orderBy("start").collect()
    ids = sorted(((i if i is not None else -1, ids_of(FILES[0], t) + [2]) for i, t, *_ in EDGE), key=lambda x: x[0])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in found] == [i for i, _ in ids]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((len(d), crc32(np.array(d))) for _, d in ids)
    at = 0
    for row in found:
        assert row["start"] == at
        at += row["n_tokens"]
    token_codes.write_codes(nothing, str(tmp_path / "none"), public_path(FILES[0]), end_id=2)
    assert token_codes.read_documents(spark, str(tmp_path / "none")).count() == 0


# ---- packing ------------------------------------------------------------------


def check_packing(rows, docs, window):
    """Every id once, no gap, and only the last sequence padded."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["key"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(d[0]["doc_tokens"] for d in by_doc.values()) == sorted(map(len, docs))
    for pieces in by_doc.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0
            at += p["length"]
        assert at == pieces[0]["doc_tokens"]
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += window - at
    assert padding < window


@pytest.mark.parametrize("window", [16, 2048])
def test_packing_places_every_id_once(edge, nothing, window):
    setting = packing.PackSettings(window=window)
    pieces, tokens = packing.pack(edge, public_path(FILES[1]), 1, setting)
    rows = pieces.collect()
    docs = [ids_of(FILES[1], t) + [1] for _, t, *_ in EDGE]
    check_packing(rows, docs, window)
    ids = {r["key"]: np.frombuffer(r["ids"], "<u2") for r in tokens.collect()}
    assert sorted(map(bytes, (i.tobytes() for i in ids.values()))) == sorted(np.array(d, "<u2").tobytes() for d in docs)
    for r in rows:
        assert r["ids_crc32"] == crc32(ids[r["key"]][r["start"] : r["start"] + r["length"]])
    whole = packing.sequences(pieces, tokens).collect()
    assert sum(len(r["ids"]) for r in whole) == 2 * sum(map(len, docs))
    assert packing.pack(nothing, public_path(FILES[1]), 1, setting)[0].count() == 0


def test_packing_by_shuffle_equals_packing_by_broadcast(edge):
    some = packing.pack(edge, public_path(FILES[1]), 1, packing.PackSettings(window=16))[0].drop("key")
    none = packing.pack(edge, public_path(FILES[1]), 1, packing.PackSettings(window=16, broadcast_rows=-1))[0].drop("key")
    assert sorted(map(str, some.collect())) == sorted(map(str, none.collect()))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1))
def test_plan_fills_windows(counts):
    setting = packing.PackSettings(window=32)
    histogram = np.zeros(33, np.int64)
    for n, k in counts.items():
        histogram[n] = k
    plan = packing.make_plan(histogram, setting)
    length = np.repeat(np.arange(33), histogram)
    number = np.concatenate([np.arange(k) for k in histogram])
    sequence, offset, part = plan.place(length, number, 32)
    cells = set()
    for n, s, o, p in zip(length, sequence, offset, part, strict=True):
        for i in range(n):
            cells.add((int(s), int(o) + i) if i < p else (int(s) + 1, i - int(p)))
    total = int((np.arange(33) * histogram).sum())
    assert len(cells) == total and plan.sequences == -(-total // 32)


def test_least_squares_meets_a_feasible_histogram():
    histogram = np.zeros(33, np.int64)
    for n in (10, 22, 20, 6):
        histogram[n] = 500
    columns = packing.combinations(np.flatnonzero(histogram), 32, 8)
    times = packing.solve(histogram, columns, 50)
    assert (10, 22)[::-1] in columns and abs(times[columns.index((22, 10))] - 500) < 1


def test_batches_are_cut_by_bytes_and_stay_whole():
    from lexifold.llm.common import in_pieces

    batch = pa.record_batch([pa.array(range(6)), pa.array(["aa", None, "b" * 50, "", "ccc", "d"])], ["i", "t"])
    pieces = list(in_pieces(iter([batch, batch.slice(0, 0)]), 1, 4))
    assert [p.num_rows for p in pieces] == [2, 1, 3]
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
