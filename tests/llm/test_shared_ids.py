"""Rows that share a doc_id are separate documents in every stage; a missing dependency takes only the corpus queries away."""

import os
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from tests.conftest import ROOT
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_mixing_quotas import brute_taken
from wavecrate.llm import mixing
from wavecrate.llm.exact_dedup import exact_dedup
from wavecrate.llm.near_dedup import near_dedup, near_groups

T, U, V = prose(11, 90), prose(12, 90), prose(13, 90)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], SCHEMA)


def kept(result):
    return Counter((r.doc_id, r.text) for r in result.collect())


def test_near_classes(spark):
    docs = frame(spark, [(1, T, "a"), (1, U, "a"), (5, T + " x", "a"), (6, U + " y", "a"), (1, V, "a"), (1, V, "a"), (7, "", "a"), (7, "", "a"), (7, None, "a")])
    got = {(r.doc_id, r.class_id, r.class_key, r.class_size) for r in near_groups(docs).collect()}
    assert len({g[2] for g in got}) == 4 and {(d, c, n) for d, c, _, n in got} == {(1, 1, 2), (5, 1, 2), (6, 1, 2), (7, 7, 3)}
    of = {d: k for d, _, k, _ in got if d in (5, 6)}
    assert of[5] != of[6]
    assert kept(near_dedup(docs)) == Counter({(1, T): 1, (1, U): 1, (1, V): 2, (7, ""): 2, (7, None): 1})  # repeated rows stay together


def test_exact_stage(spark):
    docs = frame(spark, [(1, "A", "a"), (9, "A", "a"), (1, "B", "a"), (3, "C", "a"), (3, "C", "a"), (None, "A", "a"), (None, "D", "a"), (4, None, "a"), (2, "", "a")])
    assert kept(exact_dedup(docs)) == Counter({(9, "A"): 1, (1, "B"): 1, (3, "C"): 2, (None, "D"): 1, (4, None): 1})


def test_mix_of_rows(spark):
    rows = [(k % 3 if k % 2 else None, prose(k, 40 + k), "a" if k % 4 else "b") for k in range(24)] + [(1, T, "c")] * 3
    docs = frame(spark, rows)
    whole = kept(mixing.mixed_documents(docs))
    assert set(whole) <= {(d, t) for d, t, _ in rows} and all(n <= 2 * Counter((d, t) for d, t, _ in rows)[x] for x, n in whole.items())
    assert whole == kept(mixing.mixed_documents(docs.repartition(3)))
    played = Counter(r.source for r in mixing.block_schedule(docs).collect())
    sources = {r.source: r.quota for r in mixing.measured(docs)[1].collect()}
    assert played == Counter({s: q for s, q in sources.items() if q})


def test_quotas_of_distinct_ids_by_brute_force(spark):
    docs = [(k, prose(k, 20 + 7 * k), "abc"[k % 3]) for k in range(40)]
    assert Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(frame(spark, docs)).collect()) == Counter(brute_taken(docs))


def test_stages_on_shared_ids(spark, tmp_path):
    rows = [(1, T, "a"), (1, U, "a"), (5, T + " x", "a"), (6, U + " y", "a"), (1, V, "b"), (9, V, "b"), (2, None, "b"), (None, "some text without an id", "b"), (3, "12", "b")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got <= {(1, T), (1, U), (9, V), (None, "some text without an id")} and {d for d, _ in got} >= {1, 9}


def test_stages_on_an_empty_table(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without_a_dependency():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True)
    assert done.stdout.split()[-1] == "False" and int(done.stdout.split()[-2]) > 40, done.stderr
