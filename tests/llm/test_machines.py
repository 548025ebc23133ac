"""The kernel, the scores and the votes of both classifiers against plain versions."""

import random
from itertools import combinations

import numpy as np

from tests.llm.conftest import SCHEMA
from wavecrate.llm import language, toxicity


def enumerated(a, b):
    """The gap-weighted kernel by listing every choice of LENGTH positions within SPAN, over both norms."""

    def subsequences(word):
        out = {}
        for at in combinations(range(len(word)), toxicity.LENGTH):
            width = at[-1] - at[0] + 1
            if width <= toxicity.SPAN:
                key = tuple(word[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY**width
        return out

    x, y = subsequences(a), subsequences(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / toxicity.NORM[len(a)] / toxicity.NORM[len(b)]


def spelt(word):
    rows = np.zeros((1, toxicity.WIDTH), np.uint8)
    rows[0, : len(word)] = [ord(c) - 96 for c in word]
    return rows


def featured(word):
    out = {}
    for number, weight in toxicity.features(spelt(word), len(word)):
        out[int(number[0])] = out.get(int(number[0]), 0) + weight
    return out


def test_kernel_by_enumeration():
    rng = random.Random(4)
    framed = lambda w: [toxicity.START, *[ord(c) - 96 for c in w], toxicity.STOP]
    for _ in range(40):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(2))
        x, y = featured(a), featured(b)
        assert abs(sum(v * y.get(k, 0) for k, v in x.items()) - enumerated(framed(a), framed(b))) < 1e-9


def machine():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abeorstnl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bags = []
    for k in range(240):
        words = rng.sample(plain, 12) + (["dumbhead"] if k % 6 == 0 else ["stinkard"] if k % 6 == 3 else [])
        bags.append((k % 3 == 0, sorted({spelt(w)[0].tobytes() for w in words})))
    return toxicity.SubsequenceMachine(bags), plain


def test_document_scores_by_hand_and_insertions():
    model, plain = machine()
    own = lambda w: model.bias + sum(v * float(model.weights[k]) for k, v in featured(w).items())
    score = lambda t: float(model.document_scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
    for words in (plain[:9], [*plain[9:15], "dumbhead"], ["stinkard"]):
        want = 1 / (1 + np.exp(-model.slope * (max(map(own, words)) - model.shift)))
        assert abs(score(" ".join(words)) - want) < 1e-4
    wrong = sum(score(" ".join([*plain[20:26], w[:k] + c + w[k:]])) < 0.5 for w in ("dumbhead", "stinkard") for k in range(1, 8) for c in "aiqx")
    assert wrong == 0
    assert score("no.Dumbhead") >= 0.5 and score("so—stinkard”") >= 0.5 and score("d.u.m.b.h.e.a.d") >= 0.5 and score("st1nkard") >= 0.5
    assert np.mean([score(" ".join(plain[k : k + 8])) >= 0.5 for k in range(0, 392, 8)]) == 0


def test_votes_by_hand(spark):
    rng = random.Random(3)
    letters = {"de": "aeinrstch", "en": "etaoinhw", "nl": "aeijnvgz", "fr": "aeiouqul", "es": "aeosnzñ"}
    texts = [(k, " ".join("".join(rng.choice(letters[c]) for _ in range(rng.randint(2, 7))) for _ in range(30)), c, "s", 0) for k, c in enumerate(list(letters) * 24)]
    docs = spark.createDataFrame(texts, SCHEMA)
    model = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    families = len(model.families) if len(model.families) > 1 else 0
    for k, text, *_ in texts:
        data = text.encode()
        grams = language.trigrams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
        counts = {g: grams.count(g) for g in grams}
        margin = [sum((n / len(grams)) ** 0.5 * float(w[g]) for g, n in counts.items()) + float(w[-1]) for w in model.weights]
        group = max(range(families), key=lambda f: margin[f])
        members, votes, sums = model.members[group], {}, {}
        for p, (a, b) in enumerate(model.pairs):
            if a in members:
                m = margin[families + p]
                votes[a if m >= 0 else b] = votes.get(a if m >= 0 else b, 0) + 1
                sums[a], sums[b] = sums.get(a, 0) + m, sums.get(b, 0) - m
        best = max(members, key=lambda c: (votes.get(c, 0), sums.get(c, 0), -c))
        assert got[k].lang_pred == model.langs[best]
    assert np.mean([got[k].lang_pred == c for k, _, c, *_ in texts]) > 0.9


def test_repeated_rows_count_once(spark):
    rows = [(k % 4, f"some words of text number {k % 4}", "en" if k % 2 else "fr", "s", 0) for k in range(400)]
    assert len(language.train(spark.createDataFrame(rows, SCHEMA)).langs) == 2


def test_repeated_rows_dont_hide_a_language(spark):
    """80,000 rows that repeat four documents: the largest language, and the one with the fewest documents."""
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(k, f"{w} of text number {k}", c, "s", 0) for k in range(500) for c, w in (("de", "ein paar wörter"), ("en", "some words"))], SCHEMA)
    many = spark.range(80_000).select((F.col("id") % 4 + 1_000).alias("doc_id"), F.concat(F.lit("unas palabras del texto "), F.col("id") % 4).alias("text"), F.lit("es").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = few.unionByName(many)
    model = language.train(docs)
    assert model.langs == ["de", "en", "es"]
    wrong = language.predict(docs.distinct(), model, F.col("lang")).filter("lang != lang_pred").count()
    assert wrong == 0


def test_many_languages_are_all_learned(spark):
    names = [f"x{k:03}" for k in range(140)]
    docs = spark.createDataFrame([(k * 10 + j, f"{'abcdefghijklmnop'[k % 16] * 3}{'qrstuvwxyzabc'[k % 13] * 2} " * (j + 1), c, "s", 0) for k, c in enumerate(names) for j in range(4)], SCHEMA)
    assert len(language.train(docs, rows=140).langs) == 140


def test_the_stage_follows_the_verdict(spark):
    """Letters that only one side's Unicode tables know, rows that share a doc_id, and a clashing column name."""
    rows = [(k, f"some words of text {k}", "en", "s", 0) for k in range(60)] + [(100, "\U00031350\U00031351\U00031352", "en", "s", 0), (1, "123", "en", "s", 0), (1, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as __own", "2 as __key", "3 as __ID")
    model = language.train(docs)
    told = {(r.doc_id, r.n): r.lang_pred for r in language.predict(docs, model, language.F.length("text").alias("n")).collect()}
    got = language.in_known_language(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, len(r.text), r["__own"]) for r in got.collect()) == sorted((d, n, 1) for (d, n), c in told.items() if c != "und")
    assert told[100, 3] != "und" and told[1, 3] == "und"


def test_labels_of_absent_documents_teach_nothing(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    insults = ["dumbhead", "stinkard", "lowlifer", "rotbrain", "foulmouth"]
    plain = ["".join(rng.choice("abeorstnl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(k, " ".join(rng.sample(plain, 10) + ([rng.choice(insults)] if k % 2 else [])), "en", "s", 0) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.range(200_400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    found = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert sum(found[k] != bool(k % 2) for k in range(400)) <= 2
