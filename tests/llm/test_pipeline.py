"""The pipeline's stages, one by one and together, and the registered queries' columns."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from candor.llm import queries
from tests.llm.test_operators import brute_components

DATA = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_sanitisation": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op4_neighbours": "query_id rank vec_id score",
    "op5_decontamination": "doc_id contaminated",
    "op6_near_duplicates": "doc_id n_shingles component_id kept",
    "op7_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(out.columns)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(queries.ORACLES[name]).df()
    order = sorted(want.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order).reset_index(drop=True), want[order].sort_values(order).reset_index(drop=True))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DATA)
        if name != "pack":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "near_dedup":
            keys = sorted(before)
            _, label = brute_components([before[k] for k in keys], 5, 80)
            assert ids == {keys[i] for i, c in enumerate(label) if c == i}
        elif name == "decontaminate":
            items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert not any(i in t for k, t in before.items() if k in ids for i in items) and len(ids) > 0.9 * len(before)
        elif name == "sanitise":
            assert ids == set(before)
        elif name == "pack":
            assert ids == set(before)
        texts[name] = len(ids)
        docs = out
    run = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in run.select("doc_id").collect()} == ids


def test_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
