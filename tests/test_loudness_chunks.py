"""Loudness over chunks against the measure of whole sounds; pieces of files; the limiter's scan against its loop."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrate.functions import loudness as L
from wavecrate.operators import loudness_chunks as C
from wavecrate.sources.wav_pieces import wav_pieces


def sounds():
    rng = np.random.default_rng(2)
    t = np.arange(44_100 * 7 + 123) / 44_100
    loud = np.where(t > 3, 0.5, 0.01) * np.sin(2 * np.pi * 440 * t)
    yield 1, 44_100, [loud.astype(np.float32), (rng.normal(0, 0.1, len(t))).astype(np.float32)]
    yield 2, 11_025, [rng.normal(0, 0.2, 11_025 * 4).astype(np.float32)]
    yield 3, 48_000, [rng.normal(0, 0.05, 48_000).astype(np.float32) for _ in range(5)]  # too short for a window
    yield 4, 22_050, [np.zeros(22_050 * 5, np.float32)]
    yield 5, 22_050, [np.ones(2_000, np.float32)]  # too short for a block
    yield 6, 22_050, [np.concatenate([np.full(22_050 * 4, 0.3), rng.normal(0, 0.3, 22_050 * 4)]).astype(np.float32)] * 2


def chunked(sizes):
    for track, rate, channels in sounds():
        for c, x in enumerate(channels):
            at = 0
            for k in range(10**6):
                if at >= len(x):
                    break
                n = sizes[k % len(sizes)]
                yield track, c, k, rate, x[at : at + n].tolist()
                at += n


@pytest.mark.parametrize("sizes", [(30_000,), (10**7,), (1, 40_000, 2, 17)])
def test_chunks_equal_the_whole(spark, sizes):
    if 17 in sizes:
        sizes = (1, 40_000, 2, 17, 50_000)
    frame = spark.createDataFrame(list(chunked(sizes)), C.CHUNK).repartition(5)
    got = {r.track: r for r in C.loudness(frame).collect()}
    for track, rate, channels in sounds():
        want = L.measure(channels, rate, False)
        for name in ("integrated", "short_term_max"):
            a, b = got[track][name], want[name]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (track, name, a, b)


def test_pieces_of_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    kept = {}
    for k, (rate, n, channels) in enumerate([(44_100, 300_001, 2), (22_050, 10, 1), (8_000, 0, 1)]):
        x = [rng.uniform(-1, 1, n).astype(np.float32) for _ in range(channels)]
        (tmp_path / f"{k}.wav").write_bytes(L.wav_bytes(x, rate))
        kept[k] = L.wav_channels((tmp_path / f"{k}.wav").read_bytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF no sound")
    rows = wav_pieces(spark, str(tmp_path), 100_000)
    assert rows.rdd.getNumPartitions() >= 1
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.path, r.channel, r.chunk)):
        got.setdefault((int(r.path.split("/")[-1][0]), r.channel), []).extend(r.samples)
    assert set(got) == {(0, 0), (0, 1), (1, 0)}
    for (k, c), samples in got.items():
        assert np.array_equal(np.array(samples, np.float32), kept[k][0][c])
    named = rows.withColumn("track", F.regexp_extract("path", r"(\d)\.wav$", 1).cast("long"))
    value = {r.track: r.integrated for r in C.loudness(named).collect()}
    assert abs(value[0] - L.measure(kept[0][0], 44_100, False)["integrated"]) < 1e-6 and value[1] is None


def one_by_one(want, rest):
    now, out = 1.0, []
    for goal in want.astype(np.float64).tolist():
        now = goal if goal < now else goal + (now - goal) * rest
        out.append(now)
    return np.array(out)


def test_limiter_scan_equals_the_loop_and_is_fast():
    rng = np.random.default_rng(5)
    rest = math.exp(-1 / 2205)
    for n in (0, 1, 2, 3, 1000, 44_100 * 60):
        want = np.minimum(1, rng.uniform(0.2, 1.1, n)).astype(np.float32)
        goal = want.astype(np.float64)
        began = time.process_time()
        got = L.running_minima(goal, rest, (1 - rest) * goal, 1.0)
        took = time.process_time() - began
        began = time.process_time()
        assert np.allclose(got, one_by_one(want, rest), rtol=0, atol=1e-12)
        loop = time.process_time() - began
    assert took < loop * 2  # the loop here has no arrays; the one before this scan made one for each sample


def test_limited_sound_keeps_the_ceiling():
    t = np.arange(44_100 * 2) / 44_100
    loud = (1.6 * np.sin(2 * np.pi * 97 * t) * (1 + np.sin(2 * np.pi * 3 * t)) / 2).astype(np.float32)
    out = L.limit([loud, loud / 2], 44_100)
    top = 10 ** (L.CEILING_DB / 20)
    assert max(np.abs(c).max() for c in out) <= np.float32(top) + 1e-7
    assert np.allclose(out[0] / 2, out[1], atol=1e-6)
