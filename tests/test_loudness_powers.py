"""Loudness over chunks with one shuffle: channels that go on from batch to batch, odd tracks, and samples that stay in their task."""

import numpy as np
import pytest

from tests.conftest import SF
from tests.test_loudness_chunks import chunked, sounds
from wavecrate.functions import loudness as L
from wavecrate.operators import loudness_chunks as C
from wavecrate.plans import sound_queries as S


@pytest.mark.parametrize("rows", [1, 3, 7])
def test_channels_go_on_from_batch_to_batch(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        frame = spark.createDataFrame(list(chunked((30_000, 11_111, 50))), C.CHUNK).repartition(3)
        got = {r.track: r for r in C.loudness(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {track for track, *_ in sounds()}
    for track, rate, channels in sounds():
        want = L.measure(channels, rate, False)
        for name in ("integrated", "short_term_max"):
            a, b = got[track][name], want[name]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (track, name, a, b)


def test_tracks_without_a_first_channel_or_samples_have_no_loudness(spark):
    x = np.random.default_rng(1).normal(0, 0.2, 8_000 * 4).astype(np.float32)
    rows = [(1, 1, 0, 8_000, x.tolist()), (2, 0, 0, 8_000, []), (3, 0, 0, 8_000, None), (4, 0, 0, 8_000, x.tolist()), (4, 0, 1, 8_000, []), (4, 1, 0, 8_000, x[:8_000].tolist())]
    got = {r.track: r for r in C.loudness(spark.createDataFrame(rows, C.CHUNK).coalesce(1)).collect()}
    assert set(got) == {1, 2, 3, 4} and all(got[k].integrated is None and got[k].short_term_max is None for k in (1, 2, 3))
    want = L.measure([x, np.concatenate([x[:8_000], np.zeros(24_000, np.float32)])], 8_000, False)
    assert abs(got[4].integrated - want["integrated"]) < 0.01  # the second channel ends with its samples, not with its ringing


def test_samples_stay_in_their_task_and_parts_are_shuffled_once(spark):
    frame = S.sound_loudness(spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "MapInPandas" not in plan and "samples" not in plan  # keys to tasks, parts to tracks
    assert frame.count() == spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_products_end_where_ringing_ends():
    chunk = np.random.default_rng(2).normal(0, 0.2, 20_000).astype(np.float32)
    batch = next(S._chunks(iter([S.pa.RecordBatch.from_pydict({"s_suppkey": S.pa.array([3]), "chunk": S.pa.array([1])})])))
    made = next(C._parts(iter([batch])))
    reach = len(C._ringing(S.RATE)[0])
    first, lo, hi = C._blocks(20_000, len(chunk), S.RATE)
    assert made["products"].value_lengths().to_pylist() == [6 * int((lo < reach).sum())] * 2 and made["energies"].value_lengths().to_pylist() == [len(lo)] * 2
    assert made["block"].to_pylist() == [first] * 2 and (hi > lo).all()


def test_chunks_equal_whole_tones():
    keys, numbers = [7] * 5 + [12] * 5, list(range(5)) * 2
    rows = S.pa.Table.from_batches(list(S._chunks(iter([S.pa.RecordBatch.from_pydict({"s_suppkey": S.pa.array(keys), "chunk": S.pa.array(numbers)})])))).to_pylist()
    t = np.arange(S.SECONDS * S.RATE)
    for key in (7, 12):
        tone = np.sin(2 * np.pi * (400 + key % 10 * 200) * t / S.RATE) * np.where(t < S.QUIET_SECONDS * S.RATE, S.QUIET, 0.1 + key % 10 * 0.05)
        for channel in (0, 1):
            mine = [r for r in rows if r["track"] == key and r["channel"] == channel]
            assert [r["start"] for r in mine] == [20_000 * k for k in range(5)]
            assert np.allclose(np.concatenate([r["samples"] for r in mine]), tone / (channel + 1), rtol=0, atol=1e-7)
