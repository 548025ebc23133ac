"""Collocations against a plain count over all phrases; the hash, the tree and the notice of clashing keys."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from wavecrate.llm import collocations as col


def plainly(rows, least, top):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    out = {}
    frequent = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in frequent.items():
        score, cut = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = (b for (other, q), b in frequent.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not any(100 * b >= 80 * a for b in inside):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]]))
    return sorted((lang, k + 1, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for lang, found in out.items() for k, x in enumerate(sorted(found)[:top]))


def made(seed=1, n=80):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "über", "日本", "a\x00b", "x" * 40, "no", "é", "\xa0", "<p>", "w1", "w2", "w3", "w4"]
    out = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " new york city hall "]) for _ in range(rng.randrange(120)))
        out.append((k, text, rng.choice(["en", "en", "de", None]), "s", 0))
    return out


def got(frame, least, top=2_000):
    return sorted(map(tuple, col.collocations(frame, least, top).collect()))


def test_plain_count(spark, docs, empty, nameless):
    frame = spark.createDataFrame(made(), SCHEMA)
    rows = [(t, lang) for _, t, lang, *_ in made()]
    assert got(frame, 5) == plainly(rows, 5, 2_000) != []
    assert got(frame, 5, 7) == plainly(rows, 5, 7)
    assert got(docs, 3) == plainly([(r.text, r.lang) for r in docs.select("text", "lang").collect()], 3, 2_000)
    assert got(empty, 1) == [] and got(nameless, 1) == plainly([("some text of a row without any id", "en")] * 2, 1, 2_000)


def test_many_blocks_arrays_and_branches(spark, monkeypatch):
    frame = spark.createDataFrame(made(3), SCHEMA).repartition(7)
    rows = [(t, lang) for _, t, lang, *_ in made(3)]
    for name, value in (("KEYS", 300), ("CHUNK", 16), ("FAN", 2), ("BUFFER", 50)):
        monkeypatch.setattr(col, name, value)
    assert got(frame, 4) == plainly(rows, 4, 2_000)


def test_streams_are_cut_between_pieces(monkeypatch):
    data = "one two. three four five, six; seven".encode()
    words = col.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ["en"], 0)
    whole = words.streams()
    monkeypatch.setattr(col, "STRETCH", 3)
    parts = words.streams()
    assert len(whole) == 1 and len(parts) > 2 and all(x[0] == 0 for x in parts) and np.array_equal(np.concatenate(parts), whole[0])


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 50_000, dtype=np.uint64))
    slots = col.Slots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(len(keys)))
    assert (slots.find(np.arange(1, 50_000, dtype=np.uint64)) == -1).all()
    assert sum(bits.nbytes for _, bits, _ in slots.levels) * 8 < 4 * len(keys)


SCAN = col._scan_rows


def clumsy_scan(salt):
    """Under salt 0 all words of two letters share a key."""

    def rows(batches):
        real = col.Words.sums
        col.Words.sums = lambda self, s: np.where(self.length == 2, np.uint64(7), real(self, s)) if s == 0 else real(self, s)
        try:
            yield from SCAN(salt)(batches)
        finally:
            col.Words.sums = real

    return rows


@pytest.mark.parametrize("texts", [["aa bb cc aa bb dd " * 4], ["aa aa " * 3, "bb bb " * 3]])
def test_clashing_words_change_the_salt(spark, monkeypatch, texts):
    """Words that share a key are noticed, in one slice and across slices; the next salt is taken and the result is right."""
    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(len(texts), "doc_id")
    monkeypatch.setattr(col, "_scan_rows", clumsy_scan)
    with pytest.raises(col.Clash):
        col._counted_phrases(frame, 2, 0)
    assert got(frame, 2) == plainly([(t, "en") for t in texts], 2, 2_000)


def test_clashing_phrases_are_noticed():
    words = np.array([[1, 2, 0, 0]], np.uint64), np.array([[3, 4, 0, 0]], np.uint64)
    rows = [col._array_row(0, k, np.array([5]), w, False) for k, w in enumerate(words)]
    table = col._sum(col.pa.Table.from_batches(rows))
    assert table["clash"].to_pylist() == [True] and np.frombuffer(table["count"][0].as_py(), np.int64).tolist() == [10]
    assert col._sum(col.pa.Table.from_batches([rows[0], rows[0]]))["clash"].to_pylist() == [False]
