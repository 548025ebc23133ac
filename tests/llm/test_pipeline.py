"""The pipeline's rows against its stages by brute force."""

import hashlib

import corpus_pipeline
from tests.llm.conftest import rows
from tests.llm.test_documents import brute_classes


def test_stages(spark, plain, tmp_path):
    folder = str(tmp_path / "sf")
    plain.write.parquet(f"{folder}/documents.parquet")
    kept = {}
    for d, t, *_ in rows():
        if t and any(c.isalpha() for c in t):
            kept[t] = max(kept.get(t, d), d)
    classes = brute_classes([(d, t) for t, d in kept.items()])
    texts = {d: t for t, d in kept.items() if classes[d] == d}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= set(texts)
    assert all(hashlib.sha256(r.decoded.encode()).digest() == hashlib.sha256(texts[r.doc_id].replace("▁", " ").encode()).digest() and r.n_tokens == len(r.ids) for r in got)
    assert sum(len(t.split()) for d, t in texts.items() for r in got if r.doc_id == d) > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]


def test_stage_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
