"""Fill-in-the-middle against a plain version, and the exact way back."""

import hashlib
import random
import re

from tests.llm.conftest import SCHEMA
from wavecrate.llm import fill_in_middle as fim

SPACES = " \t\n\x0b\x0c\r"


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def difficult(seed=5, n=300):
    rng = random.Random(seed)
    alphabet = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", "\x1f", "\xa0", "é", "日", "😀", "a", "<", "P", "S", "M", ">", "<P", "S>", "word"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_plain_version(spark, docs, empty, nameless):
    texts = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate([*difficult(), "x<P>y", "long words " * 200_000] * 2)], SCHEMA)
    for frame in (docs, empty, nameless, texts):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        order = lambda x: (x[0] is None, x)
        made = fim.fill_in_middle(frame)
        assert sorted(map(tuple, made.collect()), key=order) == sorted((plainly(*r) for r in rows), key=order)
        assert sorted(map(tuple, fim.restored(made).collect()), key=order) == sorted(((d, t or "") for d, t in rows), key=order)


def test_all_forms_occur(spark, docs):
    got = fim.fill_in_middle(spark.createDataFrame([(k, "a few words here", None, None, 0) for k in range(2_000)], SCHEMA)).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 2_000 for r in got}
    assert abs(share["plain"] - 0.5) < 0.05 and abs(share["spm"] - 0.4) < 0.05 and abs(share["psm"] - 0.1) < 0.03


def test_slices_change_nothing(spark, docs, monkeypatch):
    whole = sorted(map(tuple, fim.digests(docs).collect()))
    monkeypatch.setattr(fim, "SLICE_BYTES", 64)
    assert sorted(map(tuple, fim.digests(docs).collect())) == whole
