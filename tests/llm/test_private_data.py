"""Personal data: the base against plain patterns, disguises against hand-placed spans, and texts that must stay clean."""

import hashlib
import random
import re
import time

import pytest

from tests.llm.conftest import SCHEMA
from wavecrate.llm import private_data as pd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sum_is_right(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def plainly(text):
    """Base spans by the patterns as they are stated."""
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum_is_right(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def difficult(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "B.", "@", ".", "-", "+", "%", "1", "22", "255", "256", "0007", "4111", "1111", " ", " ", "(", ")", "é", "😀", "\n", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_base_by_plain_patterns():
    for text in [*difficult(1, 6_000), "a" * 3_000 + "@", "1" * 3_000, "1.2.3.4.5.6.7.8", "a@b.c@d.e", "0" * 4_000 + ".1.1.1"]:
        got = [(k, a, b) for k, a, b, disguised, _ in pd.private_spans(text) if not disguised]
        assert got == plainly(text), text


def folded(text):
    return "".join({"o": "о", "a": "а", "e": "е"}.get(c, c) for c in text)


DISGUISED = [
    ("email", "john.smith [at] example [dot] com", "john.smith@example.com"),
    ("email", "john.smith(at)example.com", "john.smith@example.com"),
    ("email", "john dot smith at mail dot example dot com", "john.smith@mail.example.com"),
    ("email", "john_at_example_dot_com", "john@example.com"),
    ("email", "john-at-my-example-dot-com", "john@my-example.com"),
    ("email", "johnATexampleDOTcom", "john@example.com"),
    ("email", "john @ example . com", "john@example.com"),
    ("email", "john@example[.]com", "john@example.com"),
    ("email", "JOHN {AT} EXAMPLE {DOT} ORG", "JOHN@EXAMPLE.ORG"),
    ("email", folded("john@example.com"), "john@example.com"),
    ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
    ("email", "jo​hn@exam­ple.com", "john@example.com"),
    ("email", "juan arroba".replace(" arroba", " (arroba) ejemplo punto es"), "juan@ejemplo.es"),
    ("phone", "plus four nine, one five one, two three four five six seven", "+49151234567"),
    ("phone", "+1 four one five five five five 0 1 9 9", "+14155550199"),
    ("phone", "+49 ١٥١ ٢٣٤٥٦٧", "+49 151 234567"),
    ("phone", "＋1 (017) 555-7713", "+1 (017) 555-7713"),
    ("card", "four one one one " + "one " * 11 + "one", "4" + "1" * 15),
    ("card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("card", "four triple one double one double one double one double one double one double one", "4" + "1" * 15),
    ("ip", "one nine two dot one six eight dot one dot two zero", "192.168.1.20"),
    ("phone", "plus cuatro nueve uno cinco uno dos tres cuatro cinco", "+491512345"),
]


@pytest.mark.parametrize("kind, disguise, plain", DISGUISED)
@pytest.mark.parametrize("before, after", [("", ""), ("Übrigens, 😀: ", ", sagte er."), ("über x.y@z.org / ", " (or 10.1.2.3)"), ("“", "”")])
def test_disguises(kind, disguise, plain, before, after):
    text = before + disguise + after
    hidden = [(k, text[a:b], p) for k, a, b, is_disguised, p in pd.private_spans(text) if is_disguised]
    assert hidden == [(kind, disguise, plain)]
    assert disguise not in pd.redact(text)


@pytest.mark.parametrize(
    "text",
    [
        "Look at example.com, or meet me at noon. Dot the i.", "one two three four five six seven eight nine", "write @user.name or @ home", "at (at) dot [dot]",
        "un dos tres quatre cinq", "a point at issue. dot", "the cat sat at the door and dotted a line at dawn", "Москва, сосна и рак", "stay-at-home.mom", "x [at] y", "see [.] and (.)",
        "plus one two", "null null null null", "he arrived at 10.30 pm", "m² of 10² at 5 . Then", "it was 5@ per piece . com",
    ],
)
def test_clean_texts_stay_clean(text):
    assert pd.private_spans(text) == []


def test_time_is_linear():
    for unit in ("a-at-", "a_at_b dot ", "one two ", "1 ", "a@", "a.", "x at y dot 1 ", "(at)", "+1 ((", "double ", "DOT", "aAT"):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            pd.private_spans(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, unit


def test_operator_and_query(spark, docs, empty, nameless):
    made = [(k, t, None, None, 0) for k, t in enumerate([*difficult(2, 200), *[d for _, d, _ in DISGUISED], "no " * 100_000 + DISGUISED[0][1]])]
    for frame in (docs, empty, nameless, spark.createDataFrame(made, SCHEMA)):
        rows = sorted(map(repr, ((r.doc_id, tuple((s.kind, s.start, s.end, s.disguised, s.plain) for s in r.spans)) for r in pd.find_private(frame).collect())))
        assert rows == sorted(repr((r.doc_id, tuple(pd.private_spans(r.text or "")))) for r in frame.select("doc_id", "text").collect())
    got = {r.doc_id: r.text for r in pd.redacted(frame).collect()}
    assert got == {k: pd.redact(t) for k, t, *_ in made}


def test_query_columns(spark, tmp_path):
    texts = ["", None, "a@b.c and 1.2.3.4", "a@b.c, 1.2.3.4, +1 (017) 555-7713, 4111 1111 1111 1111, me [at] b dot com"]
    spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pd.op12_private_data(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        base = plainly(text)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in base) for k in PLAIN]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in pd.private_spans(text)) and r.n_added == len(pd.private_spans(text)) - len(base)
