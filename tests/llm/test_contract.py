"""Names, types and row counts of the registered queries at the smallest scale, and scores on held-out rows."""

import zlib

import numpy as np
import pytest

from tests.conftest import SF
from wavecrate.llm import queries

COLUMNS = {
    "op1_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op4_sstable": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_near_dedup": {"doc_id": "bigint", "class_id": "bigint", "class_size": "bigint", "kept": "boolean"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "first_slot": "bigint", "last_slot": "bigint"},
    "op11_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op12_private_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_added": "bigint"},
    "op13_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    frame = queries.queries()[name](spark, SF)
    assert dict(frame.dtypes) == COLUMNS[name]
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    rows = frame.collect()
    if "doc_id" in frame.columns:
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if "held_out" in frame.columns:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    folder = SF.replace("0.001", "0.01")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.queries()["op2_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    bad, good = ([r.score for r in rows if toxic[r.doc_id] == k] for k in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.75  # only some thirty toxic documents to learn from here
