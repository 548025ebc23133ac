"""Genres from replies as whole operators, the services' chain, job options, and names against plain versions."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from wavecrate.functions import fuzzy, loudness
from wavecrate.operators import genre_sources as S
from wavecrate.operators import resolve
from wavecrate.plans import media_queries
from wavecrate.sources.options import read_options

ID = "00000000-0000-4000-8000-00000000000%d"


def maps(spark):
    genre_map = spark.createDataFrame([("house", "House"), ("deep house", "Deep House"), ("pop", "Pop"), ("hip hop", "Hip-Hop"), ("techno", "Techno")], "tag string, genre string")
    return genre_map, spark.createDataFrame([("Deep House", "House")], "child string, parent string")


def releases(*rows):
    return json.dumps({"results": [{"title": t, "year": y, "style": s, "genre": g} for t, y, s, g in rows]})


def test_release_genres(spark):
    asked = spark.createDataFrame([("ann one", "Ann"), ("bob two", "Bob"), ("cid three", "Cid")], "key string, artist string")
    by_field = spark.createDataFrame([
        # The stranger's release neither votes nor dates; a tag in both lists counts once.
        ("ann one", releases(("Zzyx - One", "1970", ["Techno"], ["Techno"]), ("Ann (2) - One", "1994", ["House"], ["house", "Pop"]), ("Ann - Best", "1991", ["Pop"], ["Pop"]))),
        ("bob two", releases()),
        ("cid three", releases(("Nobody at all - X", "1980", ["House"], []))),
    ], "key string, body string")
    by_text = spark.createDataFrame([("bob two", releases(("Bob - Two", "1989", ["Hip Hop"], []))), ("ann one", releases(("Ann - No", "1900", ["Techno"], [])))], "key string, body string")
    found = S.release_genres(asked, by_field, by_text, *maps(spark))
    assert sorted(tuple(r[c] for c in ("key", "genre", "tag", "year")) for r in found.collect()) == [("ann one", "House", "house", 1991), ("bob two", "Hip-Hop", "hip hop", 1989)]
    replies = json.dumps({"recordings": [{"title": "Something else", "first-release-date": "1950"}, {"title": "Two", "first-release-date": "1987-05"}]})
    dated = S.earliest_recording(spark.createDataFrame([("bob two", "Two")], "key string, track string"), spark.createDataFrame([("bob two", replies)], "key string, body string"))
    assert [tuple(r) for r in dated.collect()] == [("bob two", 1987)]
    eras = {r.key: (r.genre, r.year) for r in S.with_era(found, dated).collect()}
    assert eras == {"ann one": ("House", 1991), "bob two": ("Old School Hip-Hop", 1987)}


def test_artist_and_recording_genres(spark):
    body = lambda *names: json.dumps({"genres": [{"name": n, "count": c} for n, c in names], "tags": []})
    replies = spark.createDataFrame([(ID % 1, body(("pop", 7), ("house", 4))), (ID % 2, body(("techno", 1)))], "key string, body string")
    recordings = spark.createDataFrame([("k1", ID % 1), ("k2", "no id"), ("k3", ID % 3)], "key string, id string")
    assert [tuple(r) for r in S.recording_genres(recordings, replies, *maps(spark)).collect()] == [("k1", "House", "house")]
    artists = spark.createDataFrame([("Ann",), ("Bob",), ("Cid",)], "artist string")
    candidates = spark.createDataFrame([("ann", 0, ID % 2, "ANN"), ("bob", 0, ID % 2, "Xyzzy"), ("bob", 1, ID % 2, "Bob"), ("cid", 0, "x", "Cid")], "artist_key string, place int, id string, name string")
    assert [tuple(r) for r in S.artist_genres(artists, candidates, replies, *maps(spark)).collect()] == [("Ann", "Techno", "techno")]


def test_service_chain_asks_only_what_is_open(spark):
    items = spark.createDataFrame([(k,) for k in range(6)], "i int")
    asked = {}

    def stage(name, *known):
        def run(rows):
            asked[name] = sorted(r.i for r in rows.collect())
            return rows.filter(F.col("i").isin(*known) if known else F.lit(False)).withColumn("genre", F.lit(name))

        return run

    stages, dear = S.service_chain(F.col("i") >= 4, stage("c", 0), stage("t", 5), stage("a"), remix_release=stage("rr", 4), release=stage("r", 1), recording=stage("m", 2), top_artist=stage("l", 3), remixer=stage("x"))
    got = {r.i: (r.genre, r.source) for r in resolve.resolve(items, "i", stages, dear).collect()}
    assert got == {0: ("c", "correction"), 1: ("r", "release"), 2: ("m", "recording"), 3: ("l", "artist's top tags"), 4: ("rr", "remix release"), 5: ("t", "file tag")}
    assert asked["rr"] == [4, 5] and asked["x"] == [5] and asked["r"] == [1, 2, 3] and asked["m"] == [2, 3] and asked["l"] == [3] and asked["a"] == []


def test_options():
    assert read_options({}).target == -14 and read_options({"loudness_mode": "integrated", "target": "x"}).target == -16
    assert read_options({"loudness_mode": "convert_only", "target": -9}).target == 0 and read_options({"target": "-9.5"}).target == -9.5
    assert read_options({}).anything_to_do() and not read_options({"steps": []}).anything_to_do()
    assert not read_options({"top_tags_key": "  "}).looks_up() and read_options({"use_releases": True}).looks_up()


def plain_ratio(a, b):
    """Twice the common runs over all characters, by trying every pair of starts."""

    def runs(x, y):
        best = (0, 0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        return n + runs(x[:i], y[:j]) + runs(x[i + n :], y[j + n :]) if n else 0

    return 2 * runs(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_ratio_and_its_bound():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc дё") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert abs(fuzzy.ratio(a, b) - plain_ratio(a, b)) < 1e-12
        assert all(fuzzy.may_reach(a, b, x / 10) for x in range(11) if plain_ratio(a, b) >= x / 10)


def test_similar_titles_by_brute_force(spark):
    part = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {}
    sim = lambda a, b: plain_ratio(*(fuzzy.compare_form(x) for x in (a, b)))  # noqa: E731  # the names are ASCII
    for k, r in part.items():
        near = [(0, r.p_brand.upper(), "The " + r.p_name)] + ([(1, part[k + 1].p_brand, part[k + 1].p_name + " (Radio Edit)")] if k + 1 in part else [])
        scored = []
        for place, artist, title in near:
            t, a, c = sim(r.p_name, title), sim(r.p_brand, artist), sim(fuzzy.split_title(r.p_name)[0], fuzzy.split_title(title)[0])
            if t >= 0.55 and a >= 0.5 and c >= 0.72:
                scored.append((-(2 * c + t + a), place, c, t, a))
        if scored:
            _, place, c, t, a = min(scored)
            want[k] = (place, c, t, a)
    got = {r.id: (r.place, r.core_sim, r.title_sim, r.artist_sim) for r in media_queries.similar_titles(spark, SF).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


# Titles of which certain shares must come back exactly, or nearly.
TITLES = (
    "Война", "Майка", "Выпускной", "Бейби бой", "Белая ночь", "Ангел дождя", "Алюминиевые огурцы", "Бездельник", "Время любви пришло", "Всё решено",
    "Внутренний боец", "Будь моей тенью", "Без тебя", "Вечеринка", "Волна", "Город", "Гитара", "Героев", "Весна", "Вальс", "Витамин", "Визитка",
    "Банда Крыс", "Бабу буду", "Гангстер", "Во мне", "Акне", "Бошетунмай", "Ариведерчи", "Наизнанку", "Звуки пианино", "Чайный пьяница", "Самолет",
    "Молоко и мед", "Тридцать минут", "Южная ночь", "Положение", "Молнии",
)


def test_titles_come_back():
    back = {t: fuzzy.to_cyrillic(fuzzy.to_ascii(t)) for t in TITLES}
    assert np.mean([b.lower() == t.lower() for t, b in back.items()]) >= 0.65
    assert np.mean([fuzzy.ratio(fuzzy.compare_form(t), fuzzy.compare_form(b)) >= 0.8 for t, b in back.items()]) >= 0.9
    assert all(b.strip() for b in back.values()) and fuzzy.to_cyrillic("Noisia - Stigma")


def test_limiter_sample_by_sample():
    rng = np.random.default_rng(5)
    sr, top = 8_000, 10 ** (loudness.CEILING_DB / 20)
    for loud in (0.5, 1.0, 3.0):
        x = (rng.normal(size=4_000) * loud * (rng.random(4_000) < 0.02) + rng.normal(size=4_000) * 0.3).astype(np.float32)
        want, now, rest, ahead = np.where(np.abs(x) > top, top / np.maximum(np.abs(x), top), 1.0).astype(np.float32), 1.0, np.exp(-1 / 400), 40
        gain = []
        for k in range(len(x)):
            goal = float(want[k : k + ahead + 1].min())
            now = goal if goal < now else goal + (now - goal) * rest
            gain.append(now)
        assert np.allclose(loudness.limit([x], sr)[0], np.clip(x * np.array(gain, np.float32), -top, top), atol=1e-5)


def test_common_run_of_columns(spark):
    rows = spark.createDataFrame([("abcd", "xbcdbc"), ("", "a"), (None, "a"), ("ab", "ba"), ("ёж", "жёж")], "a string, b string")
    got = [tuple(r.r) if r.r else None for r in rows.select(fuzzy.common_run_udf("a", "b").alias("r")).collect()]
    assert got == [(1, 1, 3), (0, 0, 0), (None, None, None), (0, 1, 1), (0, 1, 2)]
