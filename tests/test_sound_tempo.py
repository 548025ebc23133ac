"""Minute-long sounds stay in their Python workers; the spared transforms, products and parts change no value."""

import numpy as np
import pytest

from tests.conftest import SF
from wavecrate.functions import loudness as L
from wavecrate.functions import signal
from wavecrate.plans import media_queries as M


def test_sounds_never_leave_their_workers(spark):
    plan = M.sound_tempo(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "run(made(" in plan


def test_a_range_is_transformed_back_once(monkeypatch):
    env, ranges, turned = np.random.default_rng(1).uniform(0, 1, 700), [(0, 700), (100, 350), (800, 900)], []
    env[200:640] = 0  # some frames are silent
    inverse = np.fft.irfft
    monkeypatch.setattr(np.fft, "irfft", lambda x, *a, **k: turned.append(np.ndim(x)) or inverse(x, *a, **k))
    got = signal.tempograms(env, ranges)
    assert turned == [1, 1] and got[2] is None
    ramp = np.arange(192) / 191
    padded = np.concatenate([env[0] * ramp, env, env[-1] * (1 - ramp)])
    for (a, b), gram in zip(ranges[:2], got[:2], strict=True):
        want = np.zeros(384)
        for k in range(a, b):
            x = padded[k : k + 384] * signal.hann(384)
            circular = np.array([x @ np.roll(x, -lag) for lag in range(384)])
            want += circular / np.abs(circular).max() if np.abs(circular).max() > signal.SILENT else 0
        assert np.allclose(gram, want / (b - a), rtol=0, atol=1e-12)


@pytest.mark.parametrize("sr", [8_000, 22_050, 44_100])
def test_bands_weigh_only_their_bins(sr):
    power = np.random.default_rng(2).uniform(0, 1, (5, 1025))
    assert np.allclose(signal.mel_powers(power, sr), power @ signal.mel_bands(sr).T, rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize(("k", "seconds", "faster"), [(0, 6, False), (7, 60, True), (8, 60, True), (59, 3, True)])
def test_a_sound_made_in_parts_is_the_whole(k, seconds, faster):
    t, root = np.arange(seconds * M.RATE) / M.RATE, 261.63 * 2 ** (k % 12 / 12)
    tone = sum(np.sin(2 * np.pi * root * 2 ** (s / 12) * t) for s in (0, 4, 7)) / 12
    gained = np.maximum(0, t - seconds / 2) / 3 if faster and k % 2 else 0
    want = (tone + ((t * (100 + k % 5 * 10) / 60 + gained) % 1 < 0.02) * 0.5).astype(np.float32)
    channels, rate = L.wav_channels(M._sound(k, seconds, faster))
    assert rate == M.RATE and len(channels) == 2
    for got in channels:
        assert len(got) == len(want) and np.abs(got - want).max() <= 1.01 / 32_768 + 0.5 / 32_768


def test_a_long_recursion_goes_on_from_part_to_part():
    x = np.random.default_rng(3).normal(0, 0.3, (64 << signal.TURNS) * 2 + 7).astype(np.float32)
    for b, a in L.k_stages(44_100):
        want, (x1, x2, y1, y2) = [], (0.1, -0.2, 0.3, 0.25)
        for v in x.tolist():
            y = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x1, x2, y1, y2 = v, x1, y, y1
            want.append(y)
        assert np.allclose(signal.biquad(x, b, a, before=(0.1, -0.2, 0.3, 0.25)), want, rtol=0, atol=1e-6)


@pytest.mark.parametrize("k", [1, 4, 9, 30])
@pytest.mark.parametrize("faster", [False, True])
def test_only_cells_near_a_beat_are_looked_at(k, faster):
    t = np.arange(60 * M.RATE) / M.RATE
    beats = t * (100 + k % 5 * 10) / 60 + (np.maximum(0, t - 30) / 3 if faster and k % 2 else 0)
    assert np.array_equal(M._clicks(k, 60, faster), np.flatnonzero(beats % 1 < M.CLICK))


def test_channels_that_are_the_same_or_differ_are_written_alike():
    rng = np.random.default_rng(4)
    x, y = (rng.uniform(-1.2, 1.2, 40_001).astype(np.float32) for _ in range(2))
    for channels in ([x], [x, x], [x, y, x.copy()], [x[:0], y[:0]]):
        want = np.floor(np.clip(np.stack(channels, 1).astype(np.float64), -1, 1) * 32767 + 0.5).astype("<i2").tobytes()
        got = L.wav_bytes(channels, 8_000)
        assert got[44:] == want and len(got) == 44 + len(want) and int.from_bytes(got[40:44], "little") == len(want)
