"""The exact rows of the pipeline by brute force."""

import math
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SCHEMA, rows
from tests.llm.test_documents import brute_classes
from tests.llm.test_mixing_quotas import brute_taken
from wavecrate.llm import pieces


def test_pipeline_rows(spark, tmp_path):
    import sentencepiece

    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(d, t, s) for d, t, _, s, _ in rows() if t and any(c.isalpha() for c in t)]
    last = {t: max(d for d, x, _ in docs if x == t) for _, t, _ in docs}
    docs = [(d, t, s) for d, t, s in docs if last[t] == d]
    classes = brute_classes([(d, t) for d, t, _ in docs])
    docs = [(d, t, s) for d, t, s in docs if classes[d] == d]
    copies = {}
    for d, n, taken in brute_taken(docs):
        copies[d] = max(copies.get(d, 0), math.floor(taken / n + 0.5))
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path(pieces.MODEL))
    want = Counter((d, tuple(model.encode(t))) for d, t, _ in docs for _ in range(copies[d]))
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
