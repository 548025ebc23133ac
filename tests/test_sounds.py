"""Every supplier's sound is analysed and rendered, against analytic values."""

import numpy as np
import pytest

from wavecrate.functions import loudness, signal
from wavecrate.plans import media_queries as M
from wavecrate.sources import audio

KEYS = [0, 5, 12, 13, 40]  # also beyond the first dozen
MAJOR = ("8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B")  # of the triads from C upwards


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sounds"))
    spark.createDataFrame([(k,) for k in [*KEYS, None]], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    return path


def test_every_sound_is_analysed(spark, folder):
    got = {r.s_suppkey: r for r in M.sound_analysis(spark, folder).collect()}
    assert set(got) == {*KEYS, None} and got[None].error
    for k in KEYS:
        assert got[k].error is None and got[k].key == MAJOR[k % 12] and abs(got[k].bpm - (100 + k % 5 * 10)) <= 1


def test_every_sound_is_rendered(spark, folder):
    got = {r.s_suppkey: r for r in M.sound_rendering(spark, folder).collect()}
    assert set(got) == {*KEYS, None} and got[None].n_bytes is None
    for k in KEYS:
        assert abs(got[k].after + 14) < 1 and got[k].true_peak < 0 and abs(got[k].n_bytes - 44 - 6 * 44_100 * 4) < 44_100 * 4


def test_copies_are_measured_once_and_one_pass_serves_tempo_and_genre(monkeypatch):
    content, passes = M._sound(7, 6, False), []
    for name in ("spectra", "tempograms"):
        whole = getattr(signal, name)
        monkeypatch.setattr(signal, name, lambda *a, name=name, whole=whole: passes.append(name) or whole(*a))
    first = audio._analysis_once(content, True, True)
    assert audio._analysis_once(bytes(bytearray(content)), True, True) == first and passes == ["spectra", "tempograms"]
    assert audio._analysis_once(content, False, False) != first


@pytest.mark.parametrize("n", [1, 20, 255, 256, 257, 3000])
def test_true_peak_of_parts_is_that_of_the_whole(n):
    def whole(channels):
        taps, peak = np.arange(33), 0.0
        place = (taps + 0.5) / 33
        window = 0.42 - 0.5 * np.cos(2 * np.pi * place) + 0.08 * np.cos(4 * np.pi * place)
        for x in channels:
            peak = max(peak, float(np.abs(x).max()))
            for phase in (1, 2, 3):
                kernel = np.sinc(taps - 16 - phase / 4) * window
                peak = max(peak, float(np.abs(np.convolve(x.astype(np.float64), (kernel / kernel.sum())[::-1])[16 : 16 + n]).max()))
        return 20 * np.log10(peak)

    noise = np.random.default_rng(n)
    for scale in (np.ones(n), np.linspace(0, 1, n) ** 4 + 1e-3, np.linspace(1, 0, n) ** 4 + 1e-3):
        channels = [(noise.uniform(-1, 1, n) * scale).astype(np.float32) for _ in range(2)]
        assert abs(loudness.true_peak_db(channels) - whole(channels)) < 1e-9
        assert loudness.true_peak_db([channels[0], channels[0].copy()]) == loudness.true_peak_db(channels[:1])
