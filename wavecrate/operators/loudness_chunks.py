"""Loudness of sounds whose samples lie in many tasks.

A sound is rows (track, channel, chunk, rate, samples), a chunk some seconds of one channel, with start (samples of its
channel before it) where the source knows it. The filters are linear: what a chunk gives is what it gives from silence plus
what the state before it (six numbers) rings on. So one pass over the samples keeps, of each chunk, the state after it from
silence, the energy from silence of each block that it overlaps, and the products of the first blocks with the six ways of
ringing, as far as these reach. These parts, a few hundred bytes a chunk, are shuffled once, by track; states are composed
from them in order, many tracks at a time, and with them the true energies. Samples never leave the task that made them.
A track's blocks are an array then, and both gates and the windows are expressions over it. No task holds more than some of
its chunks, a batch of parts, and one number for each block of a sound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions import loudness as L
from wavecrate.functions.signal import biquad, js_round

CHUNK = "track long, channel int, chunk long, rate int, samples array<float>"
KEY = ["track", "channel", "chunk"]
PART = "track long, channel int, chunk long, rate int, start long, n long, end array<double>, block long, energies array<double>, products array<double>"
Batches = Iterator[pa.RecordBatch]
POWERS = "track long, rate int, n long, powers array<double>"
FADED = 1e-18


def _filtered(x: np.ndarray, rate: float, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K-weighted samples from a state (two inputs, two values between the filters, two outputs, the later first) and the state after them."""
    after = []
    for k, (b, a) in enumerate(L.k_stages(rate)):
        y = biquad(x, b, a, before=(*state[2 * k : 2 * k + 2], *state[2 * k + 2 : 2 * k + 4]))
        after += _last(x, state[2 * k : 2 * k + 2])
        x = y
    return x, np.array([*after, *_last(x, state[4:])])


def _last(x: np.ndarray, before: np.ndarray) -> list[float]:
    return [float(v) for v in [*x[::-1][:2], *before][:2]]


def step(rate: float) -> np.ndarray:
    """What one silent sample makes of a state."""
    (b, a), (d, c) = L.k_stages(rate)
    middle = np.array([b[1], b[2], -a[0], -a[1], 0, 0])
    out = d[0] * middle + np.array([0, 0, d[1], d[2], -c[0], -c[1]])
    return np.array([np.zeros(6), [1, 0, 0, 0, 0, 0], middle, [0, 0, 1, 0, 0, 0], out, [0, 0, 0, 0, 1, 0]])


@lru_cache(maxsize=16)
def _ringing(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """What six states ring on into silence until it no longer counts (samples by six), and sums of its products up to each sample."""
    one, rows, now = step(rate), [], np.eye(6)
    largest = 0.0
    while True:
        now = one @ now
        rows.append(now[4])
        size = float(np.abs(now).max())
        largest = max(largest, size)
        if size < FADED * largest:
            break
    ring = np.array(rows)
    return ring, np.concatenate([np.zeros((1, 6, 6)), np.cumsum(ring[:, :, None] * ring[:, None, :], axis=0)])


@lru_cache(maxsize=256)
def _steps(rate: float, n: int) -> np.ndarray:
    """What n silent samples make of a state."""
    return np.linalg.matrix_power(step(rate), n)


def _sizes(rate: float) -> tuple[int, int]:
    """Samples of a block, and from one block to the next."""
    return int(js_round(0.4 * rate)), int(js_round(0.1 * rate))


def _blocks(start: int, n: int, rate: float) -> tuple[int, np.ndarray, np.ndarray]:
    """The first block that a chunk overlaps, and where each one begins and ends in it."""
    size, hop = _sizes(rate)
    first = max(0, -(-(start - size + 1) // hop))
    at = np.arange(first, max(first, (start + n - 1) // hop + 1)) * hop - start
    return first, np.clip(at, 0, n), np.clip(at + size, 0, n)


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of the values from lo to hi, along the first axis; each stretch between two of these places is added up once."""
    edges = np.unique(np.concatenate([lo, hi]))
    inner = edges[edges < len(values)]
    stretches = np.zeros((len(edges) + 1, *values.shape[1:]))
    if len(inner):
        stretches[1 : len(inner) + 1] = np.add.reduceat(values, inner, axis=0)
    before = np.cumsum(stretches, axis=0)
    return before[np.searchsorted(edges, hi)] - before[np.searchsorted(edges, lo)]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate([*rows, np.zeros(0)]))


def _parts(batches: Batches) -> Batches:
    for batch in batches:
        samples, rows = batch.column("samples"), {"n": [], "end": [], "block": [], "energies": [], "products": []}
        for k, (rate, start) in enumerate(zip(batch.column("rate").to_pylist(), batch.column("start").to_pylist(), strict=True)):
            found = samples[k].values
            x = np.zeros(0, np.float32) if found is None else found.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            y, end = _filtered(x, rate, np.zeros(6))
            y, (ring, _) = y.astype(np.float64), _ringing(rate)
            first, lo, hi = _blocks(start, len(x), rate)
            m = min(len(ring), len(y))
            rung = int(np.searchsorted(lo, m))  # blocks that ringing reaches
            products = _sums(ring[:m] * y[:m, None], lo[:rung], np.minimum(hi[:rung], m))
            for name, value in zip(rows, (len(x), end, first, _sums(y * y, lo, hi), products.ravel()), strict=True):
                rows[name].append(value)
        made = {name: pa.array(rows[name], pa.int64()) if name in ("n", "block") else _lists(rows[name]) for name in rows}
        yield pa.RecordBatch.from_pydict({name: made[name] if name in made else batch.column(name) for name in (c.split()[0] for c in PART.split(", "))})


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists, and how many each has."""
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the values of lists of these lengths: their list and their place in it."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _states(ends: np.ndarray, rate: np.ndarray, n: np.ndarray, new: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before each part, and the one after all: from silence where a channel is new, else from the part in front; all channels take a step together."""
    kinds, kind = np.unique(np.stack([rate, n]), axis=1, return_inverse=True)
    steps, kind = np.stack([_steps(float(r), int(k)) for r, k in kinds.T]), kind.ravel()
    begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    place, out = np.arange(len(new)) - begin, np.zeros((len(new), 6))
    if not new[0]:
        out[0] = state
    order = np.argsort(place, kind="stable")
    for rows in np.split(order, np.cumsum(np.bincount(place)))[1:-1]:
        out[rows] = np.einsum("kij,kj->ki", steps[kind[rows - 1]], out[rows - 1]) + ends[rows - 1]
    return out, steps[kind[-1]] @ out[-1] + ends[-1]


def _true_energies(batch: pa.RecordBatch, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The energies of a batch's blocks with what states ring on, their part and their block."""
    rate, start, n, first = (batch.column(c).to_numpy() for c in ("rate", "start", "n", "block"))
    energies, counts = _flat(batch.column("energies"))
    products, sizes = _flat(batch.column("products"))
    energies, products, rung = energies.copy(), products.reshape(-1, 6), sizes // 6
    part, place = _within(counts)
    of, at = _within(rung)
    for r in np.unique(rate):
        mine = rate[of] == r
        row, (size, hop), (_, sums) = of[mine], _sizes(float(r)), _ringing(float(r))
        lo = (first[row] + at[mine]) * hop - start[row]
        lo, hi = (np.minimum(np.clip(x, 0, n[row]), len(sums) - 1) for x in (lo, lo + size))
        s = states[row]
        more = 2 * (products[mine] * s).sum(1) + np.einsum("bi,bij,bj->b", s, sums[hi] - sums[lo], s, optimize=True)
        energies[(np.cumsum(counts) - counts)[row] + at[mine]] += more
    return np.maximum(0.0, energies), part, first[part] + place


def _powers(batches: Batches) -> Batches:
    """A row for each track of parts in the order of tracks, channels and chunks: the channels' mean squares with their gains of all whole blocks."""
    last, state, track, held = None, np.zeros(6), None, (0, 0, np.zeros(0))  # of the last part: its channel, the state after it, its track's rate, length and energies
    for batch in batches:
        if not batch.num_rows:
            continue
        tracks, channels, rate, n = (batch.column(c).to_numpy() for c in ("track", "channel", "rate", "n"))
        fresh = np.concatenate([[track != tracks[0]], tracks[1:] != tracks[:-1]])
        new = fresh | np.concatenate([[last != channels[0]], channels[1:] != channels[:-1]])
        ends = _flat(batch.column("end"))[0].reshape(-1, 6)
        states, state = _states(ends, rate, n, new, state)
        energies, part, block = _true_energies(batch, states)
        gains = np.array([*L.CHANNEL_GAINS, 1.0])[np.minimum(channels, len(L.CHANNEL_GAINS))]
        done = []
        if fresh[0] and track is not None:
            done.append((track, *held))
        if fresh[0]:
            held = (0, 0, np.zeros(0))
        bounds = [*np.flatnonzero(fresh | (np.arange(len(fresh)) == 0)), len(fresh)]
        cuts = np.searchsorted(part, bounds)
        for a, b, lo, hi in zip(bounds[:-1], bounds[1:], cuts[:-1], cuts[1:], strict=True):
            if a:
                done.append((track, *held))
                held = (0, 0, np.zeros(0))
            track, front = int(tracks[a]), channels[a:b] == 0
            found = np.bincount(block[lo:hi], energies[lo:hi] * gains[part[lo:hi]], len(held[2])) if hi > lo else np.zeros(len(held[2]))
            found[: len(held[2])] += held[2]
            held = (max(held[0], int(rate[a:b].max())), held[1] + int(n[a:b][front].sum()), found)
        last = channels[-1]
        yield from _tracks(done)
    yield from _tracks([] if track is None else [(track, *held)])


def _tracks(done: list[tuple]) -> Batches:
    """Tracks with their rates, lengths and energies as rows of powers."""
    if done:
        powers = []
        for _, rate, n, energies in done:
            size, hop = _sizes(float(rate))
            whole = np.zeros((n - size) // hop + 1 if n >= size else 0)
            whole[: len(energies)] = energies[: len(whole)] / size
            powers.append(whole)
        track, rate, n, _ = zip(*done, strict=True)
        yield pa.RecordBatch.from_pydict({"track": pa.array(track, pa.int64()), "rate": pa.array(rate, pa.int32()), "n": pa.array(n, pa.int64()), "powers": _lists(powers)})


def with_start(chunks: DataFrame) -> DataFrame:
    """Chunks with their start: from the lengths of those before, where the source hasn't given it."""
    if "start" in chunks.columns:
        return chunks
    before = Window.partitionBy("track", "channel").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    lengths = chunks.select(*KEY, F.coalesce(F.array_size("samples"), F.lit(0)).alias("n"))
    # The optimizer can't tell how long the samples are and would send them to all.
    return chunks.join(lengths.select(*KEY, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).hint("merge"), KEY)


def _samples(seconds: float) -> Column:
    return F.floor(F.col("rate") * seconds + 0.5)


def parts(chunks: DataFrame, make: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """The pass over the samples. make: turns batches of these rows into batches of chunks with start, inside the task."""
    if make is not None:
        return chunks.mapInArrow(lambda batches: _parts(make(batches)), PART)
    rows = with_start(chunks).select(*KEY, "rate", F.col("start").cast("long").alias("start"), "samples")
    return rows.mapInArrow(_parts, PART)


def powers(parts: DataFrame) -> DataFrame:
    """Track, rate, n (samples) and powers, of its whole blocks in order."""
    return parts.repartition("track").sortWithinPartitions(*KEY).mapInArrow(_powers, POWERS)


def lufs(power: Column) -> Column:
    """Minus infinity without energy."""
    return F.when(power > 0, F.lit(L.OFFSET) + F.lit(10.0) * F.log10(power)).otherwise(F.lit(float("-inf")))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is found once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gated(powers: Column) -> Column:
    """The mean over blocks above the absolute gate, then above 10 below that mean; null if nothing is left."""
    mean = lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), F.size(x))
    above = lambda x, gate: F.filter(x, lambda v: lufs(v) > gate)
    last = lambda x: F.when(F.size(x) > 0, lufs(mean(x)))
    return _with(above(powers, F.lit(L.ABSOLUTE_GATE)), lambda loud: _with(lufs(mean(loud)) - L.RELATIVE_GATE, lambda gate: _with(above(loud, gate), last)))


def loudness(chunks: DataFrame, make: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """Track, integrated and short_term_max (the loudest 3 s every second; the integrated one if shorter) of every track; null if silent.

    Samples are read once (twice without start). make: see parts.
    """
    span, hop, size, apart = (_samples(x).cast("long") for x in (3.0, 1.0, 0.4, 0.1))
    up = lambda a, b: F.floor((a + b - 1) / b)
    first = lambda w: up(w * hop, apart)
    count = lambda w: F.floor((w * hop + span - size) / apart) - first(w) + 1
    window = lambda w: gated(F.slice("powers", (first(w) + 1).cast("int"), F.greatest(F.lit(0), count(w)).cast("int")))
    windows = F.when(F.col("n") >= span, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - span) / hop)), window))
    found = powers(parts(chunks, make)).select("track", gated(F.col("powers")).alias("integrated"), F.array_max(windows).alias("short_term_max"))
    return found.select("track", "integrated", F.coalesce("short_term_max", "integrated").alias("short_term_max"))
