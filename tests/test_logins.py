"""Login failures as state: against a replay of the statements one by one, over several micro-batches, with timers."""

import random

import pytest

from wavecrate.streaming.logins import as_of, failure_changes, keyed_state


def replay(events, window, point):
    """Rows (key, second) inserted by failures, deleted by a success of their key, counted within the window that ends at the point."""
    rows = []
    for second, order, key, kind in sorted((s, kind == "ok", k, kind) for s, k, kind in events if s <= point):
        rows = [r for r in rows if r[0] != key] if kind == "ok" else [*rows, (key, second)]
    rows = [(k, s) for k, s in rows if s > point - window]
    return sorted((k, sum(r[0] == k for r in rows), min(s for q, s in rows if q == k)) for k in {k for k, _ in rows})


def made(n, seed):
    rng = random.Random(seed)
    at, out = 1_000_000, []
    for _ in range(n):
        at += rng.choice([0, 0, 1, 5, 40, 200])
        out.append((at, rng.choice(["a", "b", "c"]), rng.choice(["fail", "fail", "fail", "ok"])))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_against_replay(spark, tmp_path, batches):
    from pyspark.sql import functions as F

    events, window = made(160, batches), 900
    cuts = [len(events) * k // batches for k in range(batches + 1)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(events[lo:hi], "s long, who string, kind string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with keyed_state(spark):
            stream = spark.readStream.schema("s long, who string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
            changes = failure_changes(stream, "who", "ts", F.col("kind") == "fail", F.col("kind") == "ok", window, "0 seconds")
            changes.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    assert "HDFS" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    points = sorted({s for s, _, _ in events[::7]} | {events[-1][0], events[0][0] + 450})
    told = as_of(spark.read.parquet(str(tmp_path / "out")), "who", spark.createDataFrame([(p,) for p in points], "point long"))
    got = sorted(map(tuple, told.collect()))
    assert got == sorted((p, *row) for p in points for row in replay(events, window, p))


def test_late_rows_count_from_now_on():
    from wavecrate.streaming.logins import Failures

    known = Failures(900)
    known.see(1_000, 1, False)
    known.see(400, 2, False)  # came late, still within the window that ends at 1,000
    assert known.changes[-1] == (1_000, 1, 3, 400)
    known.see(500, 0, True)  # a late success deletes what is older
    assert known.changes[-1] == (1_000, 2, 1, 1_000)
    known.see(90, 1, False)  # too old
    assert len(known.changes) == 3
    known.pass_time(1_900)
    assert known.changes[-1] == (1_900, 3, 0, None) and known.next_expiry() == -1
