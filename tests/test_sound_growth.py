"""Sounds at size: samples stay where they are, dear functions run once, and nothing is measured that isn't wanted."""

import numpy as np
import pytest

from tests.conftest import SF
from wavecrate.functions import loudness as L
from wavecrate.functions.signal import biquad
from wavecrate.operators import loudness_chunks as C
from wavecrate.plans import media_queries as M
from wavecrate.plans import sound_queries as S
from wavecrate.sources import audio


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_starts_that_are_given_change_nothing_and_samples_are_never_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [(t, c, k, 8_000, rng.normal(0, 0.2, 9_000 + t * 7).astype(np.float32).tolist(), k * (9_000 + t * 7)) for t in range(3) for c in range(2) for k in range(4)]
    given = spark.createDataFrame(rows, C.CHUNK + ", start long")
    found = C.with_start(given.drop("start"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.track, r.chunk, r.start) for r in found.select("track", "chunk", "start").collect()) == sorted((r[0], r[2], r[5]) for r in rows)
    one, other = (sorted((r.track, r.integrated, r.short_term_max) for r in C.loudness(x).collect()) for x in (given, given.drop("start")))
    assert np.allclose(one, other, rtol=0, atol=1e-9)


def test_dear_functions_run_once(spark):
    lengths, rendering = S.sound_lengths(spark, SF), M.sound_rendering(spark, SF)
    for frame in (lengths, rendering):
        assert _plan(frame).count("made(") == 1
    assert "Repartition" in _plan(lengths)  # many sounds come from one small file of keys


def test_only_what_is_asked_for_is_measured():
    t = np.arange(22_050 * 4) / 22_050
    wav = L.wav_bytes([(0.3 * np.sin(2 * np.pi * 440 * t) * (t * 2 % 1 < 0.1)).astype(np.float32)], 22_050)
    whole, music, loud = audio._analyse(wav, True, False), audio._analyse(wav, False, False, True, False), audio._analyse(wav, True, False, False)
    assert set(music) | set(loud) == set(whole) and not set(music) & set(loud)
    assert all(x[k] == whole[k] for x in (music, loud) for k in x)


@pytest.mark.parametrize(("rate", "to"), [(8_000, 44_100), (22_050, 44_100), (48_000, 44_100), (44_100, 44_099)])
def test_resampling_equals_the_sums_over_taps(rate, to):
    x = np.random.default_rng(1).normal(0, 0.3, 3_000).astype(np.float32)
    taps, cut = np.arange(33), min(1.0, to / rate)
    window = 0.42 - 0.5 * np.cos(2 * np.pi * taps / 32) + 0.08 * np.cos(4 * np.pi * taps / 32)
    got, padded = L.resample([x], rate, to)[0], np.concatenate([np.zeros(16), x, np.zeros(50)])
    for i in range(0, len(got), 7):
        place = i * (rate / to)
        row = np.sinc((taps - 16 - min(511, int((place - int(place)) * 512)) / 512) * cut) * window
        assert abs(got[i] - padded[int(place) : int(place) + 33] @ (row / row.sum())) < 1e-6


def test_filters_and_the_limiter_equal_their_loops():
    x = np.random.default_rng(2).normal(0, 0.3, 1_000).astype(np.float32)
    (b, a), want, before = L.k_stages(8_000)[0], [], [0.0, 0.0, 0.0, 0.0]
    for v in x.tolist():
        y = b[0] * v + b[1] * before[0] + b[2] * before[1] - a[0] * before[2] - a[1] * before[3]
        before = [v, before[0], y, before[2]]
        want.append(y)
    assert np.allclose(biquad(x, b, a), want, atol=1e-6)
    for ahead in (1, 2, 7, 240):
        assert np.array_equal(L.least_ahead(x, ahead), [x[k : k + ahead + 1].min() for k in range(len(x) - ahead)])
