"""Registered queries on the smallest tables, against SQL or the shape they promise."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from lexifold.llm.oracle import ORACLE
from lexifold.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark", "embeddings"):
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    found, expected = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE[name]).df()
    assert len(found)
    pd.testing.assert_frame_equal(ordered(found), ordered(expected), check_dtype=False)


COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_token_codes": "doc_id start n_tokens ids_crc32",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op8_html_main": "page_id url text n_chars",
    "op9_near_dedup": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_keeps_its_contract(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert " ".join(found.columns) == COLUMNS[name]
    table, key = ("pages", "page_id") if name == "op8_html_main" else ("documents", "doc_id")
    ids = [r[0] for r in duck.sql(f"select {key} from {table}").fetchall()]
    assert sorted(found[key].unique()) == sorted(ids)
    assert name == "op2_pack" or len(found) == len(ids)


def test_all_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_act_on_what_is_left(spark, duck):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, FOLDER), f"test_{name}")
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    packed = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert sorted(packed["doc_id"].unique()) == sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    texts = [r["text"].lower() for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    items = [r[0].lower() for r in duck.sql("select text from benchmark").fetchall()]
    assert not any(" ".join(i.split()) in " ".join(t.split()) for i in items for t in texts)


def test_pipeline_on_edge_rows(spark, edge, nothing):
    for docs in (edge, nothing):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.materialise(stage(spark, kept, FOLDER), "edge")
            assert kept.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
        assert packed.count() >= kept.count() and (docs is edge) == bool(kept.count())
