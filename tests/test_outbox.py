"""Versioned delivery, in-order release and cancellation."""

import random
import threading
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from wavecrate.operators.jobs import Batch
from wavecrate.streaming import outbox
from wavecrate.streaming.logins import keyed_state
from wavecrate.streaming.outbox import Outbox, deliver_versions
from wavecrate.streaming.release import PLACES, ReleaseProcessor, in_order

SCHEMA = "id long, v long, at long, genre string"


def test_an_edit_between_send_and_acknowledgement(spark, tmp_path):
    sent = []

    def send(rows):
        got = [tuple(r) for r in rows.collect()]
        sent.append(got)
        if len(sent) == 1:  # while the first send is under way, its first entry is edited
            box.put(spark.createDataFrame([(0, 2, 500, "edited")], SCHEMA), 1)
        return rows.select("id", "v")

    box = Outbox(spark.createDataFrame([], SCHEMA).schema, "id", "v", ["at"], send, str(tmp_path / "box"), spark)
    box.put(spark.createDataFrame([(k, 1, k, "first") for k in range(450)], SCHEMA), 0)
    assert box.drain() == 0
    assert [len(x) for x in sent] == [200, 200, 50, 1] and sent[-1] == [(0, 2, 500, "edited")]
    assert [r[2] for x in sent[:3] for r in x] == list(range(450))
    assert box.acknowledged().filter("id = 0").count() == 2
    assert box.drain() == 0 and len(sent) == 4


def test_a_replaced_version_is_never_sent_and_refusals_wait(spark, tmp_path):
    answers, sent = [None, "all", "some", "all"], []

    def send(rows):
        sent.append(sorted((r.id, r.v) for r in rows.collect()))
        answer = answers[len(sent) - 1]
        return None if answer is None else rows.select("id", "v") if answer == "all" else rows.filter("id % 2 = 0").select("id", "v")

    box = Outbox(spark.createDataFrame([], SCHEMA).schema, "id", "v", ["at"], send, str(tmp_path / "box"), spark)
    box.put(spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 1, 3, "c")], SCHEMA), 0)
    assert box.drain() == 2 and sent == [[(1, 2), (2, 1)]]
    assert box.drain() == 0 and sent[1] == [(1, 2), (2, 1)]
    box.put(spark.createDataFrame([(3, 1, 4, "d"), (4, 1, 5, "e")], SCHEMA), 1)
    assert box.drain() == 0 and sent[2:] == [[(3, 1), (4, 1)], [(3, 1)]]


def test_streamed_entries(spark, tmp_path):
    sent = []

    def send(rows):
        sent.append(sorted((r.id, r.v) for r in rows.collect()))
        return rows.select("id", "v")

    def once():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        deliver_versions(stream, "id", "v", ["at"], send, str(tmp_path / "box"), str(tmp_path / "cp")).awaitTermination()

    spark.createDataFrame([(k, 1, k, "x") for k in range(3)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    once()
    spark.createDataFrame([(1, 2, 9, "y")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once()
    assert sent == [[(0, 1), (1, 1), (2, 1)], [(1, 2)]]


def test_many_entries_in_linear_work(spark, tmp_path, monkeypatch):
    """Each send scans its run of the cursor alone, so sends take equally long whatever has been sent before."""
    monkeypatch.setattr(outbox, "RUN", 2_000)
    times = []

    def send(rows):
        began = time.time()
        rows.count()
        times.append(time.time() - began)
        return rows.select("id", "v")

    box = Outbox(spark.createDataFrame([], SCHEMA).schema, "id", "v", ["at"], send, str(tmp_path / "box"), spark)
    box.put(spark.range(12_000).selectExpr("id", "1L AS v", "(id * 7919) % 12000 AS at", "'g' AS genre"), 0)
    assert box.drain() == 0
    assert 60 <= len(times) <= 66 and box.acknowledged().distinct().count() == 12_000
    assert sum(times[-20:]) < 3 * sum(times[5:25]) + 1


def test_results_leave_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(who, k, f"{who}{k}") for who in "abc" for k in range(60)]
    rng.shuffle(rows)
    rows = rows[:100] + rows[40:60] + rows[100:]  # some come again
    seen = []
    for n in range(5):
        part = rows[n * 40 : (n + 1) * 40]
        spark.createDataFrame(part, "who string, place int, name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with keyed_state(spark):
            stream = spark.readStream.schema("who string, place int, name string").parquet(str(tmp_path / "in"))
            out = in_order(stream, "who", "place", ["name"])
            out.writeStream.foreachBatch(lambda d, b: seen.append([tuple(r) for r in d.collect()])).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        have = {}
        for who, place, _ in rows[: (n + 1) * 40]:
            have.setdefault(who, set()).add(place)
        due = {who: next(k for k in range(61) if k not in places) for who, places in have.items()}
        got = [r for batch in seen for r in batch]
        for who, upto in due.items():  # all that can have left, in order, and nothing else
            assert [r for r in got if r[0] == who] == [(who, k, f"{who}{k}") for k in range(upto)]
    assert sum(map(len, seen)) == 180


def test_what_comes_early_is_kept_by_runs():
    """A batch reads and writes a key's state by runs of places, not by rows; later runs stay untouched until they are due."""
    calls, values, value = [], {}, [None]
    due = SimpleNamespace(get=lambda: value[0], update=lambda v: calls.append("due") or value.__setitem__(0, v))
    early = SimpleNamespace(
        getValue=lambda k: calls.append("get") or values.get(k), updateValue=lambda k, v: calls.append("put") or values.__setitem__(k, v), removeKey=lambda k: calls.append("drop") or values.pop(k)
    )
    processor = ReleaseProcessor("who", "place", ["name"], "")
    processor.init(SimpleNamespace(getValueState=lambda *_: due, getMapState=lambda *_: early))
    send = lambda places, mark="x": [tuple(r) for r in processor.handleInputRows(("a",), iter([("a", p, f"{mark}{p}") for p in places]), None)]
    n = 3 * PLACES
    assert send(range(n - 1, 0, -1)) == [] and calls == ["put"] * 3 + ["due"] and value[0] == (0, n - 1)
    calls.clear()
    assert send([5, 6], "again") == [] and calls == ["get", "due"]
    calls.clear()
    assert send([0, 1], "again") == [("a", 0, "again0"), *[("a", p, f"x{p}") for p in range(1, n)]]
    assert calls == ["get"] * 3 + ["drop"] * 3 + ["due"] and value[0] == (n, 0) and not values
    calls.clear()
    assert send([3, n]) == [("a", n, f"x{n}")] and calls == ["due"]


def slow(rows):
    """Half a second for each row."""

    def wait(batches):
        for batch in batches:
            time.sleep(0.5 * batch.num_rows)
            yield batch

    return rows.repartition(1).mapInArrow(wait, rows.schema)


def test_cancel_half_way(spark, tmp_path):
    items = spark.range(12)
    job = Batch(items, "id", slow, str(tmp_path / "out"), 2)
    told = []

    def listener(p):
        told.append((p.done, p.total))
        if p.done == 2:
            threading.Timer(0.3, job.cancel).start()  # in the middle of the third group

    began = time.time()
    end = job.run(listener)
    assert (end.done, end.total) == (2, 6) and told == [(0, 6), (1, 6), (2, 6)]
    kept = sorted(r.id for r in job.results().collect())
    assert kept == [0, 1, 2, 3] and time.time() - began < 30
    again = Batch(items, "id", slow, str(tmp_path / "out"), 2)
    seen = []
    assert again.run(lambda p: seen.append(p.done)).done == 6 and seen == [2, 3, 4, 5, 6]
    assert sorted(r.id for r in again.results().collect()) == list(range(12))
    assert items.agg(F.sum("id")).first()[0] == 66  # the session's other jobs go on


def test_progress_counts_tasks(spark, tmp_path):
    job, seen = Batch(spark.range(4), "id", slow, str(tmp_path / "out"), 4), []
    thread = threading.Thread(target=job.run)
    thread.start()
    while thread.is_alive():
        seen.append(job.progress())
        time.sleep(0.1)
    assert job.progress().done == 1 and any(p.tasks for p in seen)


def test_wide_sends_take_a_fixed_number_of_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outbox, "RUN", 500)
    calls, sizes = [], []

    def send(rows):
        calls.append(1)
        sizes.extend(r["count"] for r in rows.groupBy("send").count().collect())
        return rows.filter("id % 3 <> 0" if len(calls) == 1 else "true")

    box = Outbox(spark.createDataFrame([], SCHEMA).schema, "id", "v", ["at"], send, str(tmp_path / "box"), spark, wide=True)
    box.put(spark.range(2_000).selectExpr("id", "1L v", "id at", "'x' genre"), 0)
    assert box.drain() == 0
    assert len(calls) == 2 and max(sizes) <= 200 and sum(sizes) == 2_000 + 667
    assert box.acknowledged().select("id").distinct().count() == box.acknowledged().count() == 2_000


def test_a_wide_send_without_an_acknowledgement_ends_the_drain(spark, tmp_path):
    calls = []

    def send(rows):
        calls.append(1)
        return rows.filter("at < 200" if len(calls) == 1 else "true")

    box = Outbox(spark.createDataFrame([], SCHEMA).schema, "id", "v", ["at"], send, str(tmp_path / "box"), spark, wide=True)
    box.put(spark.range(450).selectExpr("id", "1L v", "id at", "'x' genre"), 0)
    assert box.drain() == 250 and len(calls) == 1
    assert box.drain() == 0 and len(calls) == 2
