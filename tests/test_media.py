"""Signals, loudness and tags against analytic values and independent loops."""

import struct

import numpy as np

from wavecrate.functions import loudness as L
from wavecrate.functions import signal as S
from wavecrate.sources import lookups
from wavecrate.sources.tags import genre_value, read_tags

SR = 22_050


def clicks(bpm, seconds=12):
    t = np.arange(seconds * SR) / SR
    return ((t * bpm / 60) % 1 < 0.02).astype(np.float32) * 0.5


def test_tempo():
    for bpm in (100, 128, 174):
        assert abs(S.detect_tempo(clicks(bpm), SR) - bpm) <= 1
    assert S.detect_tempo(np.zeros(SR, np.float32), SR) is None
    steady = S.analyze_tempo(clicks(120, 75), SR)
    assert steady["mode"] == "constant" and abs(steady["bpm"] - 120) <= 1 and len(steady["windows"]) >= 2
    assert S.analyze_tempo(np.concatenate([clicks(100, 60), clicks(125, 60)]), SR)["mode"] == "dynamic"


def test_key():
    t = np.arange(4 * SR) / SR
    for semitone, code in ((0, "8B"), (7, "9B"), (9, "11B")):
        y = sum(np.sin(2 * np.pi * 261.6256 * 2 ** ((semitone + s) / 12) * t) for s in (0, 4, 7))
        found = S.detect_key(y.astype(np.float32), SR)
        assert found["key"] == code and found["confident"]
    assert S.detect_key(np.zeros(100, np.float32), SR) == {"key": None, "confidence": None, "confident": False}


def test_features():
    t = np.arange(SR) / SR
    centroid, width, crossings = S.spectral_features(np.sin(2 * np.pi * 1000 * t).astype(np.float32), SR)
    assert abs(centroid - 1000) < 40 and abs(crossings - 2000 / SR) < 0.005
    assert S.spectral_features(np.zeros(SR, np.float32), SR)[:2] == (0.0, 0.0)
    assert np.allclose(S.mel_inverse(S.mel([100.0, 1000.0, 5000.0])), [100, 1000, 5000])


def test_biquad_matches_a_loop():
    x, b, a = np.random.default_rng(0).normal(size=1000), (0.2, 0.3, 0.1), (-1.2, 0.5)
    y = np.zeros(1000)
    for i in range(1000):
        y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k - 1] * y[i - k] for k in (1, 2) if i >= k)
    assert np.allclose(S.biquad(x, b, a), y, atol=1e-5)


def test_loudness():
    t = np.arange(5 * 48_000) / 48_000
    tone = [(np.sin(2 * np.pi * 997 * t) * 10 ** (-23 / 20)).astype(np.float32)] * 2
    found = L.measure(tone, 48_000)
    assert abs(found["integrated"] + 23.0) < 0.1 and abs(found["true_peak"] + 23.0) < 0.1
    assert L.measure([np.zeros(48_000, np.float32)], 48_000) == {"integrated": None, "short_term_max": None, "true_peak": -120.0}
    z = np.array([[1e-9], [0.1], [0.1], [0.001]])  # gated by hand: -70 drops the first, -10 the last
    assert abs(L.gated_loudness(z) - (-0.691 + 10 * np.log10(0.1))) < 1e-9


def test_limiter_and_trim():
    x = np.zeros(SR, np.float32)
    x[5000:6000] = 1.5
    out = L.limit([x, x / 2], SR)
    assert np.abs(out[0]).max() <= 10 ** (-1 / 20) + 1e-6 and out[1][5500] < 0.75
    assert len(L.trim_silence([x], SR)[0]) == 999 + int(L.js_round(0.3 * SR)) + int(L.js_round(0.05 * SR))
    quiet = [np.zeros(10, np.float32)]
    assert L.trim_silence(quiet, SR) is quiet


def test_resample_and_wav():
    t = np.arange(SR) / SR
    y = L.resample([np.sin(2 * np.pi * 440 * t).astype(np.float32)], SR, 44_100)[0]
    assert len(y) == 44_100 and np.abs(y[1000:-1000] - np.sin(2 * np.pi * 440 * np.arange(44_100) / 44_100)[1000:-1000]).max() < 0.01
    channels, sr = L.wav_channels(L.wav_bytes([np.array([0, 0.5, -2], np.float32)] * 2, 8000))
    assert sr == 8000 and len(channels) == 2 and np.allclose(channels[0] * 32768, [0, 16384, -32767])


def frame(name, text):
    return struct.pack(">4sIH", name, len(text) + 1, 0) + b"\x03" + text


def test_id3():
    body = frame(b"TPE1", "Ä".encode()) + frame(b"TIT2", b"T") + frame(b"TCON", b"(17)") + b"\0" * 20
    data = b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body
    assert read_tags(data, ".mp3") == ["Rock", "Ä", "T"]
    assert read_tags(data[:20], ".mp3") == [None, None, None]
    old = b"ID3\x02\0\0\0\0\0\x0b" + b"TT2\0\0\x05" + b"\0abc\0"
    assert read_tags(old, "") == [None, None, "abc"]
    assert [genre_value(v) for v in ("(17)", "(17)Own", "17", "999", "", "Own")] == ["Rock", "Own", "Rock", None, None, "Own"]


def test_flac_and_mp4():
    pairs = [b"genre=House", b"ARTIST=A", b"artist=B", b"broken"]
    block = struct.pack("<I", 3) + b"ven" + struct.pack("<I", 4) + b"".join(struct.pack("<I", len(p)) + p for p in pairs)
    assert read_tags(b"fLaC\x84" + len(block).to_bytes(3, "big") + block, ".flac") == ["House", "A", None]
    atom = lambda name, body: struct.pack(">I", len(body) + 8) + name + body
    value = lambda body: atom(b"data", b"\0" * 8 + body)
    tags = atom(b"\xa9nam", value("Té".encode())) + atom(b"gnre", value(b"\0\x12"))
    data = atom(b"moov", atom(b"udta", atom(b"meta", b"\0\0\0\0" + atom(b"ilst", tags))))
    assert read_tags(data, ".m4a") == ["Rock", None, "Té"]
    assert read_tags(None, ".m4a") == [None, None, None]


def test_polite_fetching():
    calls, waits = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("503")
        return "{}"

    assert lookups.fetch_json("u", get, waits.append) == "{}" and len(calls) == 3 and waits == [0.6, 1.2]
