"""Orders of busy keys in buckets and cells against plain windows; tables whose columns have our own names."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavecrate.operators import events as E
from wavecrate.operators.catalog import unique_paths


def rows(spark):
    rng = random.Random(7)
    made = [(k, "busy" if k % 3 else rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(50), rng.randrange(10_000)]), float(rng.randrange(40)), k, k, k, k) for k in range(900)]
    return spark.createDataFrame(made, "id long, who string, at long, v double, pos long, n long, cell long, row long")


def test_against_plain_windows(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 16)
    frame, w = rows(spark), Window.partitionBy("who").orderBy("at", "id")
    bag = lambda d: sorted(map(repr, d.collect()))
    step = F.col("v") - F.lag("v").over(w)
    assert bag(E.rising_flux(frame, "who", ["at", "id"], "v")) == bag(frame.withColumn("flux", F.when(step.isNotNull(), F.greatest(step, F.lit(0.0)))))
    assert bag(E.lookahead_min(frame, "who", ["at", "id"], "v", 5)) == bag(frame.withColumn("ahead_min", F.min("v").over(w.rowsBetween(0, 5))))
    peaks = frame.withColumn("b", F.lag("v").over(w)).withColumn("a", F.lead("v").over(w)).filter("v > b and v > a").drop("a", "b")
    assert bag(E.local_peaks(frame, "who", ["at", "id"], "v")) == bag(peaks)
    plain = frame.drop("pos", "n").withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("who")))
    got = E.positions(frame.drop("pos", "n"), "who", ["at", "id"]).select(*plain.columns)
    assert bag(got.withColumn("pos", F.col("pos").cast("long"))) == bag(plain)
    for kind in ("string", "timestamp", "date"):
        typed = frame.drop("pos", "n").withColumn("at", F.col("at").cast("string") if kind == "string" else F.timestamp_seconds(F.col("at") * 9_999).cast(kind))
        want = typed.withColumn("pos", F.row_number().over(w) - 1)
        assert bag(E.positions(typed, "who", ["at", "id"]).select("id", F.col("pos").cast("int"))) == bag(want.select("id", "pos"))
    assert E.rising_flux(frame.limit(0), "who", ["at", "id"], "v").collect() == []


def test_paths_of_tables_with_our_names(spark):
    frame = spark.createDataFrame([(k, "x.mp3", "r", "s", 1, 2, 3) for k in range(3)], "k long, path string, root string, stem string, number long, __k long, place long")
    got = sorted(map(tuple, unique_paths(frame, "path", "k").collect()))
    assert got == [(k, "x.mp3", "r", "s", 1, 2, 3, "x.mp3" if not k else f"x ({k + 1}).mp3") for k in range(3)]
    swapped = frame.toDF("k", "root", "path", "stem", "number", "__k", "place")
    assert sorted(r.unique_path for r in unique_paths(swapped, "root", "k").collect()) == ["x (2).mp3", "x (3).mp3", "x.mp3"]
