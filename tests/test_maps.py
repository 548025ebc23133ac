"""Genre maps, messages, the chain, catalogue paths and queues."""

from pyspark.sql import functions as F

from wavecrate.functions import display
from wavecrate.operators import events, resolve
from wavecrate.sources import audio, genre_map, lookups


def test_map_files(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text('{"deep house": "Old", "salsa": "Latin"}')
    loaded = genre_map.load_map(spark, str(path))
    new, histogram = genre_map.build_map(loaded)
    assert {r.tag: r.genre for r in new.collect()} == {"deep house": "Deep House", "salsa": "Latin"}
    assert {r.genre: (r.n_before, r.n_after) for r in histogram.collect()} == {"Deep House": (0, 1), "Latin": (1, 1), "Old": (1, 0)}
    assert genre_map.change_counts(loaded, new).first()[:] == (1, 0)
    genre_map.write_map(loaded, new, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert genre_map.load_map(spark, str(tmp_path / "missing")).count() == 0


def test_messages(spark):
    texts = spark.createDataFrame([("en", "a", "A {n}"), ("ru", "a", "А {n}"), ("en", "b", "B")], "lang string, key string, text string")
    rows = display.translated(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", texts, "ru").orderBy("k")
    assert [r[0] for r in rows.select(display.filled(F.col("text"), {"n": F.lit(2)})).collect()] == ["А 2", "B", "c"]
    result = spark.createDataFrame([(None, ["clean.spaces"], None, "House", "file tag", 120, "dynamic", 118.0, 125.0, "8A", False, 1.25)], "error string, name_changes array<string>, identified_as string, genre string, genre_source string, bpm int, bpm_mode string, bpm_min double, bpm_max double, key string, key_confident boolean, gain_db double")
    assert result.select(display.described()).first()[0] == ["name cleaned: clean.spaces", "genre House from file tag", "tempo 120 (118.0 to 125.0)", "key 8A (unsure)", "gain +1.3 dB"]


def test_chain_without_lookups(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    known = lambda k, genre: lambda rows: rows.filter(F.col("i") == k).withColumn("genre", F.lit(genre))
    stages = resolve.chain(F.lit(False), False, known(1, "A"), None, None, None, None, None, known(2, "B"), known(2, "C"))
    assert sorted(tuple(r) for r in resolve.resolve(items, "i", stages).collect()) == [(1, "A", "correction"), (2, "B", "file tag"), (3, "Unknown", "no match")]


def test_catalogue(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.mp3", "Funk / Soul", b"1"), (2, "a.mp3", "Funk / Soul", b"2")], "k int, name string, genre string, content binary")
    placed = audio.catalogue(rows, "k")
    assert [r.unique_path for r in placed.orderBy("k").collect()] == ["Funk & Soul/a.mp3", "Funk & Soul/a (2).mp3"]
    audio.write_catalogue(placed, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_scan(spark, tmp_path):
    (tmp_path / "x.MP3").write_bytes(b"ID3")
    (tmp_path / "y.txt").write_bytes(b"x")
    got = audio.with_tags(audio.scan(spark, str(tmp_path))).orderBy("name").collect()
    assert [(r["name"], r["state"], r["tags"]["genre"]) for r in got] == [("x.MP3", "accepted", None), ("y.txt", "wrong_type", None)]


def test_latest_and_rule(spark):
    log = spark.createDataFrame([(1, "k", "A"), (2, "k", "B"), (3, "", "C"), (4, "", "D")], "at int, key string, genre string")
    kept = events.latest_corrections(log, ["key"], ["at"], F.col("key") == "").orderBy("at").collect()
    assert [(r["at"], r["place"]) for r in kept] == [(2, 1), (3, 3), (4, 3)]
    votes = spark.createDataFrame([(1, "x", "A"), (2, "x", "B"), (3, "x", "B"), (4, "x", "A"), (5, "y", "A")], "at int, artist string, genre string")
    assert [(r["artist"], r["genre"], r["votes"]) for r in events.artist_rule(votes, "artist", "genre", "at").collect()] == [("x", "A", 2)]


def test_replies(spark):
    body = '{"genres":[{"name":"Low","count":1},{"name":"Top","count":5}],"tags":[{"name":"","count":9},{"name":"Tag"}]}'
    got = lookups.entity_tags(spark.createDataFrame([("k", body)], "key string, body string")).orderBy("place").collect()
    assert [r.tag for r in got] == ["top", "low", "tag"]
    asked = spark.createDataFrame([("a", "u1"), ("a", "u1"), ("b", "u2")], "key string, url string")

    def get(url):
        raise OSError("HTTP 403")

    replies = lookups.fetched(asked, "itunes", get, lambda s: None).collect()
    assert sorted(r.error for r in replies) == ["HTTP 403", "not asked any more"]
