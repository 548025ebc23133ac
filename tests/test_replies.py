"""The reply store over sessions, and top tags of artists and tracks."""

import json

from pyspark.sql import functions as F

from tests.conftest import SF
from wavecrate.operators import genre_sources as S
from wavecrate.operators.resolve import resolve
from wavecrate.plans import service_queries
from wavecrate.sources import lookups
from wavecrate.sources.reply_store import ReplyStore


def requests(spark, *keys):
    return spark.createDataFrame([(k, f"http://x/{k}") for k in keys], "key string, url string")


def test_a_second_run_asks_only_what_is_lacking(spark, tmp_path):
    asked, bodies = [], {"a": '{"n":1}', "b": "{}"}

    def fetch(wanted, service):
        keys = sorted(r.key for r in wanted.collect())
        asked.append((service, keys))
        return wanted.sparkSession.createDataFrame([(k, bodies.get(k), None if k in bodies else "HTTP 503") for k in keys], "key string, body string, error string")

    def run(*keys, service="tags"):
        store = ReplyStore(spark, str(tmp_path / "store"))  # a new session each time
        n = store.ask(service, requests(spark, *keys), fetch, F.length("body") > 2)
        return n, {r.key: (r.state, r.body) for r in store.latest(service).collect()}

    assert run("a", "b", "c", "a") == (3, {"a": ("answered", '{"n":1}'), "b": ("empty", "{}"), "c": ("failed", None)})
    assert asked == [("tags", ["a", "b", "c"])]
    assert run("a", "b")[0] == 0 and asked[-1] == ("tags", [])  # answers and empty ones stand
    bodies["c"] = '{"n":3}'
    assert run("a", "c", "d") == (2, {"a": ("answered", '{"n":1}'), "b": ("empty", "{}"), "c": ("answered", '{"n":3}'), "d": ("failed", None)})
    assert asked[-1] == ("tags", ["c", "d"])
    assert run("a", service="other")[0] == 1  # services don't share keys
    store = ReplyStore(spark, str(tmp_path / "store"))
    assert sorted(map(tuple, store.replies("tags").collect())) == [("a", '{"n":1}'), ("c", '{"n":3}')]
    # A later failure never replaces an answer.
    spark.createDataFrame([("tags", "a", "failed", None, "lost", 99)], "service string, key string, state string, body string, error string, generation long").write.mode("append").parquet(str(tmp_path / "store" / "replies"))
    assert [tuple(r) for r in store.replies("tags").filter("key = 'a'").collect()] == [("a", '{"n":1}')]


def test_with_the_polite_caller(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "store"))
    fetch = lambda wanted, service: lookups.fetched(wanted, service, get=lambda url: json.dumps({"url": url}), wait=lambda s: None)
    assert store.ask("musicbrainz", requests(spark, "x", "y"), fetch, F.col("body").isNotNull()) == 2
    assert store.ask("musicbrainz", requests(spark, "x", "y"), fetch, F.col("body").isNotNull()) == 0
    assert json.loads(store.replies("musicbrainz").filter("key = 'x'").first().body) == {"url": "http://x/x"}


def test_top_tags(spark):
    genre_map = spark.createDataFrame([("house", "House"), ("deep house", "Deep House"), ("pop", "Pop")], "tag string, genre string")
    parents = spark.createDataFrame([("Deep House", "House")], "child string, parent string")
    tags = lambda *t: {"toptags": {"tag": [{"name": n, "count": c} for n, c in t]}}
    bodies = {
        "child": tags(("Pop", 100), ("House", 90), ("deep house", 9)), "stray": tags(("House", 100), ("deep house", 9)), "vague": tags(("seen live", 100), ("pop", 3)),
        "nothing": tags(), "unknown": tags(("zzz", 1)), "strange": {"error": 6},
    }
    rows = lambda wrap: spark.createDataFrame([(k, json.dumps(wrap(b))) for k, b in bodies.items()], "key string, body string")
    want = {"child": "Deep House", "stray": "House", "vague": "Pop"}
    assert {r.key: r.genre for r in S.top_tag_genres(rows(lambda b: b), genre_map, parents).collect()} == want
    assert {r.key: r.genre for r in S.top_tag_genres(rows(lambda b: {"track": b}), genre_map, parents, True).collect()} == want


def test_dear_stages_run_once(spark):
    """Each stage's function is computed once although all later ones need what it left open."""
    items = spark.range(6).withColumnRenamed("id", "i")
    counts = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def stage(k):
        def rows(batches):
            for batch in batches:
                counts[k].add(batch.num_rows)
                yield batch

        return lambda left: left.mapInArrow(rows, "i long").filter(F.col("i") % 3 == k).withColumn("genre", F.lit(f"g{k}"))

    got = resolve(items, "i", [(f"s{k}", stage(k)) for k in range(3)], ("s0", "s1", "s2"))
    assert {r.i: r.genre for r in got.collect()} == {k: f"g{k % 3}" for k in range(6)}
    assert [c.value for c in counts] == [6, 4, 2]


def test_settled_answers_are_written_once(spark):
    """Each dear stage keeps its own answers and what it leaves open, not all answers so far; columns without a type stay."""
    items, written = spark.range(6).select(F.col("id").alias("i"), F.lit(None).alias("nothing")), []

    def kept(rows):
        written.extend(r.i for r in rows.collect() if "genre" in rows.columns)
        return rows

    stage = lambda k: lambda left: left.filter(F.col("i") % 3 == k).withColumn("genre", F.lit(f"g{k}"))
    stages = [(f"s{k}", stage(k)) for k in range(3)]
    want = {k: f"g{k % 3}" for k in range(6)}
    assert {r.i: r.genre for r in resolve(items, "i", stages, ("s0", "s1", "s2"), kept).collect()} == want
    assert sorted(written) == list(range(6))
    assert {r.i: r.genre for r in resolve(items, "i", stages, ("s1", "s2")).collect()} == want


def test_service_tables_are_read_once(spark, monkeypatch):
    """Parts are counted and read once, lines read once, however many services and stages there are."""
    counts = {"part": spark.sparkContext.accumulator(0), "lineitem": spark.sparkContext.accumulator(0)}

    def load(session, folder, name):
        def rows(batches):
            for batch in batches:
                counts[name].add(batch.num_rows)
                yield batch

        table = session.read.parquet(f"{folder}/{name}.parquet")
        return table.mapInArrow(rows, table.schema)

    monkeypatch.setattr(service_queries, "load", load)
    service_queries.service_genres(spark, SF)
    size = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    assert counts["lineitem"].value == size("lineitem") and counts["part"].value <= 2 * size("part")


def test_free_text_counts_where_the_fields_found_nothing(spark):
    body = lambda *titles: json.dumps({"results": [{"title": t, "year": "1990", "style": [], "genre": []} for t in titles]})
    replies = lambda *rows: spark.createDataFrame(rows, "key string, body string")
    by_field = replies(("a", body("A - 1", "A - 2")), ("b", body()), ("c", "broken"), ("e", body("E - 1")), (None, body("N - 1")))
    by_text = replies(("a", body("A - 3")), ("b", body("B - 1")), ("c", body("C - 1", "C - 2")), ("d", body("D - 1")), ("e", body()))
    got = sorted((r.key, r.place, r.artist) for r in lookups.releases(by_field, by_text).filter("key is not null").collect())
    assert got == [("a", 0, "A"), ("a", 1, "A"), ("b", 0, "B"), ("c", 0, "C"), ("c", 1, "C"), ("d", 0, "D"), ("e", 0, "E")]
