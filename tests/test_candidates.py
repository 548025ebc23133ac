"""Candidate search: recall 1 of the gates' best among all pairs of the smallest part table, and ties, repeats and empty names."""

from pyspark.sql import functions as F

from tests.conftest import SF
from wavecrate.functions import fuzzy
from wavecrate.operators.candidates import search


def test_recall_of_the_best_over_all_pairs(spark):
    parts = [(r.p_partkey, r.p_brand, r.p_name) for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    asked = [(k, a.upper(), t.replace("e", "a") if k % 2 else t + " (Radio Edit)") for k, a, t in parts[:60]]

    def total(artist, title, a, t):
        title_sim, artist_sim, core = fuzzy.similarity(title, t), fuzzy.similarity(artist, a), fuzzy.similarity(fuzzy.split_title(title)[0], fuzzy.split_title(t)[0])
        good = title_sim >= fuzzy.MIN_TITLE and artist_sim >= fuzzy.MIN_ARTIST and core >= fuzzy.MIN_CORE
        return 2 * core + title_sim + artist_sim if good else None

    known = {}
    want = {}
    for q, artist, title in asked:
        for _, a, t in parts:
            if (artist, title, a, t) not in known:
                known[artist, title, a, t] = total(artist, title, a, t)
        want[q] = max((x for x in (known[artist, title, a, t] for _, a, t in parts) if x is not None), default=None)
    queries = spark.createDataFrame(asked, "query long, artist string, title string")
    catalogue = spark.createDataFrame(parts, "candidate long, artist string, title string")
    cores = queries.withColumn("title", fuzzy.core_udf("title"))  # a version in brackets says nothing of the recording
    found = search(cores, catalogue, "query", "candidate")
    assert found.groupBy("query").count().filter("count > 8").count() == 0
    best = fuzzy.best_candidates(queries.join(found.drop("score"), "query"), "query", "place").collect()
    got = {r.query: 2 * r.core_sim + r.title_sim + r.artist_sim for r in best}
    assert all(w is None or abs(got[q] - w) < 1e-9 for q, w in want.items()) and sum(w is not None for w in want.values()) > 50


def test_ties_repeats_and_empty_names(spark):
    catalogue = spark.createDataFrame([(k, "Ann", "Blue Song") for k in range(30, 10, -1)] + [(1, "Bob", "Blue Song"), (2, "Ann", "Blue Songs"), (3, None, "x"), (4, "!", "?")], "c long, artist string, title string")
    queries = spark.createDataFrame([(1, "ann", "blue song"), (2, "", "Blue Song"), (3, "Ann", None), (4, "Cid", "Blue Song"), (5, "ann", "blue song")], "q long, artist string, title string")
    got = {}
    for r in search(queries, catalogue, "q", "c").collect():
        got.setdefault(r.q, []).append((r.place, r.c, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {q: [(k, 11 + k, 3.0) for k in range(8)] for q in (1, 5)}
    assert search(queries.limit(0), catalogue, "q", "c").collect() == [] == search(queries, catalogue.limit(0), "q", "c").collect()


def test_rows_are_read_once_and_bags_are_of_different_texts(spark):
    """The catalogue's rows are read once, the queries' twice (their names, and the rows that get the answers)."""
    counts = {"q": spark.sparkContext.accumulator(0), "c": spark.sparkContext.accumulator(0)}

    def counted(id_):
        def rows(batches):
            for batch in batches:
                counts[id_].add(batch.num_rows)
                yield batch

        return spark.range(400).select(F.col("id").alias(id_), F.concat(F.lit("Ann "), (F.col("id") % 3).cast("string")).alias("artist"), F.lit("Blue Song").alias("title")).mapInArrow(rows, f"{id_} long, artist string, title string")

    got = {}
    for r in search(counted("q"), counted("c"), "q", "c").collect():
        got.setdefault(r.q, []).append((r.place, r.c, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {q: [(k, q % 3 + 3 * k, 3.0) for k in range(8)] for q in range(400)}
    assert {k: c.value for k, c in counts.items()} == {"q": 800, "c": 400}
