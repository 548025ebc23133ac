"""Labels and scores of the licence scan against a search of every place, and that no other document has a say in them."""

import re

import duckdb
import pytest

from tests.llm.conftest import SCHEMA
from wavecrate.llm import licenses

FILLER = "some words that stand before and after what is looked for"


def texts():
    out = ["", None, FILLER, "under the MIT License and under the mit license", "cc-by-nc cc by nc, CC BY NC!", "Apache License, Version 2.0 apache"]
    for _, _, words, places in licenses.templates():
        out += [" ".join(words), f"{FILLER} {' '.join(words).upper()} {FILLER}", " ".join(k for _, key in places for k in key), " ".join(words[1:]), " ".join(words[:-1])]
        if len(places) > 1:  # a name of two and of nine words within the notice
            at = places[0][0] + len(places[0][1]) if places[0][0] < places[1][0] else places[1][0] + len(places[1][1])
            out += [" ".join([*words[:at], *["x"] * n, *words[at:]]) for n in (2, 9)]
    return out


def brute(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words, labels, best = re.findall(licenses.WORD, (text or "").translate(fold)), set(), 0.0
    stands = lambda at, key: at >= 0 and words[at : at + len(key)] == key
    for label, _, spelt, places in licenses.templates():
        first = places[0][0]
        for i in range(len(words)):
            reach = lambda q: range(-3 - abs(q - first) // 10, 4 + abs(q - first) // 10)
            if stands(i, places[0][1]) and all(any(stands(i - first + q + d, key) for d in reach(q)) for q, key in places[1:]):
                labels.add(label)
                own = [0 <= i - first + q < len(words) and words[i - first + q] == w for q, w in enumerate(spelt)]
                best = max(best, sum(own) / len(own))
    return ",".join(sorted(labels)), best


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts())], SCHEMA)


def test_labels_and_score_by_brute_force(frame):
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame).collect()}
    for k, t in enumerate(texts()):
        want = brute(t)
        assert got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-12, t
    assert "lgpl" in {x for v in got.values() for x in v[0].split(",")}


def test_other_documents_do_not_matter(spark, frame):
    whole = {r.doc_id: tuple(r) for r in licenses.scan(frame).collect()}
    for k in (7, 31, 52):
        assert [tuple(r) for r in licenses.scan(frame.filter(f"doc_id = {k}")).collect()] == [whole[k]]


def test_sql(frame):
    con = duckdb.connect()
    documents = frame.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT * FROM documents")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({licenses.ORACLE['op3_license_scan']})").fetchall()
    assert sorted(want) == sorted(tuple(r[c] for c in columns) for r in licenses.scan(frame).collect())
