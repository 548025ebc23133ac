"""A small table of difficult documents: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

import pytest

EXTRA = "kept string, size int, n int, h int, t int, k int, taken int, range int, sid int, bands int, recipe int, chunk int, label string, shard int, block int"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def rows():
    base, long_ = prose(1, 120), prose(2, 40_000, 5000)
    near = base.split()
    near[60] = "changed"
    passage = "this passage of more than fifty bytes stands in several of the documents word for word"
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"),
        (4, None, "en", "b"), (5, "", None, None), (6, "   \n\t ", "fr", None), (7, long_, "de", "c"), (8, long_ + " end", "de", "c"),
        (9, prose(3, 50) + " " + passage + " " + prose(4, 50), "en", "a"), (10, prose(5, 20) + "\n" + passage, "fr", "a"),
        (11, "1234 5678 !!", "en", "d"), (12, "Released under the MIT License. Apache License, Version 2.0; under the mit license", "en", "d"),
        (13, "ça été ñandú 日本語 😀 ▁x  y z", "fr", "d"), (14, "one two", "en", "d"), (15, "ONE, two!", "en", "d"), (16, "a" * 3000, "en", "d"),
        (17, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "en", "d"),
    ]
    return [(d, t, lang, s, 0) for d, t, lang, s in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def plain(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, plain):
    from pyspark.sql import functions as F

    return plain.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", ")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nameless(spark):
    return spark.createDataFrame([(None, "some text of a row without any id", "en", "a", 0), (1, "some text of a row without any id", "en", "a", 0)], SCHEMA)
