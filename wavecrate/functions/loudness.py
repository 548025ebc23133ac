"""Loudness: K-weighting, gated means, true peak, gain, limiter, trim, resampling and WAV bytes, over numpy arrays."""

from __future__ import annotations

import struct
from fractions import Fraction

import numpy as np

from wavecrate.functions.signal import biquad, js_round

# Fixed values.
CHANNEL_GAINS = (1.0, 1.0, 1.0, 1.41, 1.41)
ABSOLUTE_GATE, RELATIVE_GATE, OFFSET = -70.0, 10.0, -0.691
SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416)  # Hz, dB, Q, exponent
PASS = (38.13547087602444, 0.5003270373238773)  # Hz, Q
CEILING_DB, SILENCE_DB, NO_PEAK_DB = -1.0, -80.0, -120.0
PHASES, HALF_TAPS, PEAK_FACTOR, PEAK_PART = 512, 16, 4, 256  # samples that are looked at together
BODY_PART, RESAMPLED, MANY, WIDEST = 1 << 14, 1 << 18, 64, 1024  # samples of a file that are written together, samples resampled at once; outputs and widest window of one product


def k_stages(sr: float) -> list[tuple[tuple, tuple]]:
    """Coefficients of the shelf and of the high pass."""
    hz, db, q, e = SHELF
    k, high = np.tan(np.pi * hz / sr), 10 ** (db / 20)
    band, norm = high**e, 1 + k / q + k * k
    shelf = ((high + band * k / q + k * k) / norm, 2 * (k * k - high) / norm, (high - band * k / q + k * k) / norm), (2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm)
    hz, q = PASS
    k = np.tan(np.pi * hz / sr)
    norm = 1 + k / q + k * k
    return [shelf, ((1.0, -2.0, 1.0), (2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm))]


def k_weighted(x: np.ndarray, sr: float) -> np.ndarray:
    """The shelf, then the high pass, each in single precision."""
    for b, a in k_stages(sr):
        x = biquad(x, b, a)
    return x


def block_powers(channels: list[np.ndarray], sr: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and mean squares (blocks by channels) of 400 ms blocks every 100 ms, and their length."""
    size, step, n = int(js_round(0.4 * sr)), int(js_round(0.1 * sr)), len(channels[0])
    if n < size:
        return np.zeros(0, np.int64), np.zeros((0, len(channels))), size
    starts = np.arange(1 + (n - size) // step) * step
    powers: list[np.ndarray] = []
    for k, c in enumerate(channels):
        same = _same_before(channels, k)
        if same is None:
            s = np.concatenate([[0.0], np.cumsum(k_weighted(c, sr).astype(np.float64) ** 2)])
        powers.append(powers[same] if same is not None else (s[starts + size] - s[starts]) / size)
    return starts, np.stack(powers, 1), size


def _same_before(channels: list[np.ndarray], k: int) -> int | None:
    """The first channel before the k-th that has its samples, as both of a mono recording do."""
    return next((j for j in range(k) if channels[j] is channels[k] or np.array_equal(channels[j], channels[k])), None)


def block_loudness(z: np.ndarray) -> np.ndarray:
    """Of the last axis, the channels; minus infinity without energy."""
    gains = np.array([CHANNEL_GAINS[c] if c < len(CHANNEL_GAINS) else 1.0 for c in range(z.shape[-1])])
    total = (z * gains).sum(-1)
    return np.where(total > 0, OFFSET + 10 * np.log10(np.maximum(total, 1e-300)), -np.inf)


def gated_loudness(z: np.ndarray) -> float | None:
    """Mean over blocks above the absolute gate, then above 10 below that mean; null if nothing is left."""
    loud = block_loudness(z) if len(z) else np.zeros(0)
    first = loud > ABSOLUTE_GATE
    if not first.any():
        return None
    kept = first & (loud > float(block_loudness(z[first].mean(0))) - RELATIVE_GATE)
    out = float(block_loudness(z[kept].mean(0))) if kept.any() else -np.inf
    return out if np.isfinite(out) else None


def true_peak_db(channels: list[np.ndarray]) -> float:
    """The greatest magnitude at four times the rate, by 33 windowed taps a phase."""
    taps = np.arange(2 * HALF_TAPS + 1)
    place = (taps + 0.5) / len(taps)
    window = 0.42 - 0.5 * np.cos(2 * np.pi * place) + 0.08 * np.cos(4 * np.pi * place)
    kernels = [np.sinc(taps - HALF_TAPS - phase / PEAK_FACTOR) * window for phase in range(1, PEAK_FACTOR)]
    kernels = [(kernel / kernel.sum())[::-1] for kernel in kernels]
    gain, peak = max(float(np.abs(kernel).sum()) for kernel in kernels) * (1 + 1e-9), 0.0
    for k, x in enumerate(channels):
        if not len(x) or _same_before(channels, k) is not None:
            continue
        # A part whose samples, and those that its taps reach, are too low for the peak so far can't hold a higher one.
        parts = -(-len(x) // PEAK_PART)
        padded = np.concatenate([np.zeros(HALF_TAPS), x, np.zeros(HALF_TAPS + (parts + 1) * PEAK_PART - len(x))])
        tops = np.abs(padded[: (parts + 1) * PEAK_PART]).reshape(-1, PEAK_PART).max(1)
        tops = np.maximum(tops[:-1], tops[1:])
        peak = max(peak, float(np.abs(x).max()))
        for part in np.argsort(-tops):
            if tops[part] * gain <= peak:
                break
            cut = padded[part * PEAK_PART : min(len(x), (part + 1) * PEAK_PART) + 2 * HALF_TAPS]
            peak = max(peak, *(float(np.abs(np.convolve(cut, kernel, "valid")).max()) for kernel in kernels))
    return 20 * float(np.log10(peak)) if peak > 0 else NO_PEAK_DB


def measure(channels: list[np.ndarray], sr: float, with_true_peak: bool = True) -> dict:
    """Integrated loudness, the loudest 3 s every second (the integrated one if shorter), and the true peak if asked for."""
    starts, z, size = block_powers(channels, sr)
    whole, n = gated_loudness(z), len(channels[0])
    span, hop, best = int(js_round(3 * sr)), int(js_round(sr)), None
    if n >= span and len(z):
        for begin in range(0, n - span + 1, hop):
            lo, hi = np.searchsorted(starts, begin), np.searchsorted(starts, begin + span - size, "right")
            value = gated_loudness(z[lo:hi])
            best = value if best is None or (value is not None and value > best) else best
    return {"integrated": whole, "short_term_max": whole if best is None else best, "true_peak": true_peak_db(channels) if with_true_peak else None}


def apply_gain(channels: list[np.ndarray], db: float) -> list[np.ndarray]:
    """Nothing within 0.01 dB."""
    return channels if abs(db) <= 0.01 else [(c.astype(np.float64) * 10 ** (db / 20)).astype(np.float32) for c in channels]


def running_minima(least: np.ndarray, slope: float, shift: np.ndarray, start: float, block: int = 64) -> np.ndarray:
    """X -> min(least, slope * x + shift) for one place after another, from `start`: all values on the way.

    Two such steps make one of the same kind, so the steps of a block are composed over 1, 2, 4, ... places, all blocks at
    once; then each block's last one takes the value before the block to the one after it.
    """
    n, rows = len(least), -(-len(least) // block)
    if not n:
        return np.zeros(0)
    # Steps in front of the first that change nothing fill its block.
    fill = rows * block - n
    low, add, by = (np.concatenate([np.full(fill, x), y]).reshape(rows, block) for x, y in ((np.inf, least), (0.0, shift), (1.0, np.full(n, slope))))
    reach = 1
    while reach < block:
        later = by[:, reach:]
        both = np.minimum(low[:, reach:], later * low[:, :-reach] + add[:, reach:]), later * add[:, :-reach] + add[:, reach:], later * by[:, :-reach]
        low[:, reach:], add[:, reach:], by[:, reach:] = both
        reach *= 2
    befores = []
    for lowest, plus, times in zip(low[:, -1].tolist(), add[:, -1].tolist(), by[:, -1].tolist(), strict=True):
        befores.append(start)
        start = min(lowest, times * start + plus)
    return np.minimum(low, by * np.array(befores)[:, None] + add).ravel()[fill:]


def least_ahead(x: np.ndarray, ahead: int) -> np.ndarray:
    """The least of each value and the `ahead` that follow it, of len(x) - ahead places, over spans of 1, 2, 4, ... places."""
    span, n = 1, len(x) - ahead
    while span * 2 <= ahead + 1:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[ahead + 1 - span :][:n])


def limit(channels: list[np.ndarray], sr: float) -> list[np.ndarray]:
    """All channels by one gain: the least of the next 5 ms, at once down, and up over 50 ms."""
    top, n = 10 ** (CEILING_DB / 20), len(channels[0])
    peak = np.max(np.abs(np.stack(channels)), axis=0).astype(np.float64)
    want = np.where(peak > top, top / np.maximum(peak, top), 1.0).astype(np.float32)
    if not (want < 1).any():  # a gain of 1 throughout
        return [np.clip(c, -top, top).astype(np.float32) for c in channels]
    ahead = max(1, int(js_round(0.005 * sr)))
    want = least_ahead(np.concatenate([want, np.ones(ahead, np.float32)]), ahead) if n else want
    # Each sample takes a gain x to min(goal, rest * x + (1 - rest) * goal): at once down, geometrically up.
    rest, goal = float(np.exp(-1 / max(1, js_round(0.05 * sr)))), want.astype(np.float64)
    gain = running_minima(goal, rest, (1 - rest) * goal, 1.0).astype(np.float32)
    return [np.clip(c * gain, -top, top).astype(np.float32) for c in channels]


def trim_silence(channels: list[np.ndarray], sr: float) -> list[np.ndarray]:
    """From 50 ms before the first to 300 ms after the last sample over -80 dB; a silent signal stays."""
    loud = np.flatnonzero(np.max(np.abs(np.stack(channels)), axis=0) > 10 ** (SILENCE_DB / 20))
    if len(loud) < 2:
        return channels
    start, stop = max(0, loud[0] - int(js_round(0.05 * sr))), min(len(channels[0]), loud[-1] + int(js_round(0.3 * sr)))
    return [c[start:stop] for c in channels]


def resample(channels: list[np.ndarray], rate: float, to: float) -> list[np.ndarray]:
    """33 windowed taps at one of 512 phases for each sample."""
    if rate == to:
        return channels
    taps, cut = np.arange(2 * HALF_TAPS + 1), min(1.0, to / rate)
    window = 0.42 - 0.5 * np.cos(2 * np.pi * taps / (len(taps) - 1)) + 0.08 * np.cos(4 * np.pi * taps / (len(taps) - 1))
    table = np.sinc((taps - HALF_TAPS - np.arange(PHASES)[:, None] / PHASES) * cut) * window
    table = (table.astype(np.float32) / table.sum(1, keepdims=True)).astype(np.float32)
    n = max(1, int(js_round(len(channels[0]) * to / rate)))
    table, out, width = table.astype(np.float64), [np.zeros(n, np.float32) for _ in channels], len(taps)
    # Whole rates in a small ratio repeat their phases: `many` outputs of every `step` inputs are one matrix product.
    ratio = Fraction(rate) / Fraction(to)
    turns = -(-MANY // ratio.denominator)
    step, many = ratio.numerator * turns, ratio.denominator * turns
    if step + width > WIDEST or many > WIDEST:
        step, many = 0, 1
    else:
        at = [divmod(k * ratio.numerator, ratio.denominator) for k in range(many)]
        round_base, round_phase = np.array([b for b, _ in at]), np.array([r * PHASES // ratio.denominator for _, r in at])
        weights = np.zeros((round_base[-1] + width, many))
        weights[round_base[None, :] + taps[:, None], np.arange(many)] = table[round_phase].T
    padded = [np.concatenate([np.zeros(HALF_TAPS), c, np.zeros(HALF_TAPS + 2 + width + step)]) for c in channels]
    block = RESAMPLED // many * many
    for lo in range(0, n, block):
        size = min(n - lo, block)
        center = np.arange(lo, lo + size) * (rate / to)
        base = np.floor(center).astype(np.int64)
        phase = np.minimum(PHASES - 1, ((center - base) * PHASES).astype(np.int64))
        rest = np.arange(size)
        if step:
            rows = -(-size // many)
            begin = lo // many * step
            near = ((begin + np.arange(rows) * step)[:, None] + round_base).ravel()[:size]
            for x, y in zip(padded, out, strict=True):
                windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x[begin:], len(weights))[::step][:rows])
                y[lo : lo + size] = (windows @ weights).ravel()[:size]
            # Those whose place in double precision lies on the other side of a phase's edge follow one by one.
            rest = np.flatnonzero((near != base) | (np.tile(round_phase, rows)[:size] != phase))
        for some in np.array_split(rest, -(-len(rest) // 65_536) or 1):
            for x, y in zip(padded, out, strict=True):
                y[lo + some] = np.einsum("ij,ij->i", np.lib.stride_tricks.sliding_window_view(x, width)[base[some]], table[phase[some]])
    return out


def downmix(channels: list[np.ndarray], sr: float, seconds: float = 120) -> np.ndarray:
    """The mean of the channels, two minutes at most."""
    out = channels[0][: int(seconds * sr)].astype(np.float32)  # a copy
    for c in channels[1:]:
        out += c[: int(seconds * sr)]
    out /= np.float32(len(channels))
    return out


def wav_bytes(channels: list[np.ndarray], sr: int) -> bytes:
    """16-bit PCM, clamped, halves up, 44 bytes of header."""
    k, body = len(channels), np.empty((len(channels[0]), len(channels)), "<i2")
    same = [_same_before(channels, c) for c in range(k)]
    for c, x in enumerate(channels):
        for lo in range(0, len(body) if same[c] is None else 0, BODY_PART):
            part = np.clip(x[lo : lo + BODY_PART].astype(np.float64), -1, 1)
            part *= 32767
            part += 0.5
            part = np.floor(part, out=part).astype("<i2")
            for other in range(k):
                if other == c or same[other] == c:
                    body[lo : lo + BODY_PART, other] = part
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + body.nbytes, b"WAVE", b"fmt ", 16, 1, k, sr, sr * k * 2, k * 2, 16, b"data", body.nbytes)
    return b"".join([head, body.data])


def wav_channels(content: bytes) -> tuple[list[np.ndarray], int]:
    """Channels and rate of 16-bit PCM; anything else raises ValueError."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = struct.unpack("<4sI", content[at : at + 8])
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data" and form:
            if form[0] != 1 or form[5] != 16:
                raise ValueError("only 16-bit PCM is read")
            raw = np.frombuffer(content[at + 8 : at + 8 + size], "<i2")
            raw = raw[: len(raw) // form[1] * form[1]].reshape(-1, form[1])
            return [raw[:, c].astype(np.float32) * np.float32(1 / 32768) for c in range(form[1])], form[2]
        at += 8 + size + size % 2
    raise ValueError("no sound in the file")
