"""Delivery of corrections: no entry past a batch's limit is lost, and failed sends are taken up again; path naming row by row."""

import random

from wavecrate.operators.catalog import unique_paths
from wavecrate.streaming.failures import deliver


def test_delivery_of_450_entries_with_a_failure(spark, tmp_path):
    schema = "id long, at long, file string"
    spark.createDataFrame([(k, k, f"f{k}") for k in range(450)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    acked, sent, fail = set(), [], [True]

    def send(rows):
        ids = [r.id for r in rows.collect()]
        sent.append(ids)
        if len(sent) == 2 and fail:  # the second request gets no answer
            fail.clear()
            return
        acked.update(ids)

    def acknowledged():
        return spark.createDataFrame([(k,) for k in sorted(acked)], "id long")

    def once():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        deliver(stream, "id", acknowledged, ["at"], send, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()

    once()
    assert [len(x) for x in sent] == [200, 200] and len(acked) == 200
    once()  # nothing new came in; what was left goes out
    assert acked == set(range(450)) and [len(x) for x in sent] == [200, 200, 200, 50]
    spark.createDataFrame([(450, 450, "late")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once()
    assert acked == set(range(451)) and sent[-1] == [450]


def one_by_one(paths):
    used, out = set(), []
    for path in paths:
        dot = path.rfind(".")
        stem, ext = (path[:dot], path[dot:]) if dot > 0 else (path, "")
        name, n = path, 2
        while name in used:
            name, n = f"{stem} ({n}){ext}", n + 1
        used.add(name)
        out.append(name)
    return out


def named(spark, paths):
    rows = spark.createDataFrame(list(enumerate(paths)), "k long, path string")
    return [r.unique_path for r in sorted(unique_paths(rows, "path", "k").collect(), key=lambda r: r.k)]


def test_paths_are_named_in_order(spark):
    assert named(spark, ["x.mp3", "x.mp3", "x (2).mp3"]) == ["x.mp3", "x (2).mp3", "x (2) (2).mp3"]
    assert named(spark, ["x (2).mp3", "x.mp3", "x.mp3", "x.mp3"]) == ["x (2).mp3", "x.mp3", "x (3).mp3", "x (4).mp3"]
    assert named(spark, []) == []


def test_paths_against_one_by_one(spark):
    rng = random.Random(3)
    for _ in range(4):
        stems = ["a", "a (2)", "a (3)", "a (2) (2)", "a (4)", "b", "b (02)", ".c", "d.e", "a (2) (3)", "b (12)"]
        paths = [rng.choice(stems) + rng.choice([".mp3", ".mp3", "", ".x y"]) for _ in range(150)]
        assert named(spark, paths) == one_by_one(paths)
