"""Loudness of sounds that tasks make in chunks, and lengths and peaks of rendered ones, held to what formulas say about pure tones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.functions import loudness as L
from wavecrate.operators import loudness_chunks as C
from wavecrate.sources import audio
from wavecrate.sources.tables import load

RATE, SECONDS, QUIET_SECONDS, QUIET, CHUNK_SECONDS = 8_000, 12, 4, 0.02, 2.5
CHUNKS_A_TASK, ROWS = 512, 64  # of two channels; rows of one Arrow batch
SOUNDS_A_TASK = 32  # bounds an Arrow batch, as a rendered sound has up to a megabyte


@lru_cache(maxsize=10)
def _pitch(hz: int) -> np.ndarray:
    """Sines and cosines of a tone over a chunk."""
    at = 2 * np.pi * hz * np.arange(int(CHUNK_SECONDS * RATE)) / RATE
    return np.stack([np.sin(at), np.cos(at)])


def _chunk(key: int, chunk: int) -> np.ndarray:
    """A chunk of a supplier's tone: sin(a + b) = sin a cos b + cos a sin b, where a is the chunk's place."""
    size, hz = int(CHUNK_SECONDS * RATE), 400 + key % 10 * 200
    at = np.arange(chunk * size, min(SECONDS * RATE, (chunk + 1) * size))
    place = 2 * np.pi * hz * chunk * size / RATE
    return np.array([np.cos(place), np.sin(place)]) @ _pitch(hz)[:, : len(at)] * np.where(at < QUIET_SECONDS * RATE, QUIET, 0.1 + key % 10 * 0.05)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and numbers of chunks as chunks of two channels, the second half as strong."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS // 2):
            batch = whole.slice(lo, ROWS // 2)
            keys, chunks = (np.repeat(batch.column(c).to_numpy(), 2) for c in ("s_suppkey", "chunk"))
            waves = [_chunk(int(k), int(n)) for k, n in zip(keys[::2], chunks[::2], strict=True)]
            samples = np.concatenate([x for wave in waves for x in (wave, wave / 2)]).astype(np.float32)
            ends = np.cumsum([0, *np.repeat([len(wave) for wave in waves], 2)]).astype(np.int32)
            columns = {"track": pa.array(keys, pa.int64()), "channel": pa.array(np.tile([0, 1], len(waves)), pa.int32()), "chunk": pa.array(chunks, pa.int64()), "rate": pa.array([RATE] * len(keys), pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | {"samples": pa.ListArray.from_arrays(ends, samples), "start": pa.array(chunks * int(CHUNK_SECONDS * RATE), pa.int64())})


def _tones(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a tone for each supplier: quiet, then loud; pitch and strength by the key."""
    chunks = -(-SECONDS * RATE // int(CHUNK_SECONDS * RATE))
    keys = load(spark, d, "supplier").filter("s_suppkey is not null").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    tasks = max(1, -(-keys.count() // CHUNKS_A_TASK))  # one number; few keys stand for much sound, so sizes alone would put them in one task
    return keys.repartition(tasks, "s_suppkey", "chunk")


def sound_loudness(spark: SparkSession, d: str) -> DataFrame:
    """Integrated and short-term loudness to a tenth, over chunks, which are made and measured in the same task."""
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5).cast("long")
    return C.loudness(_tones(spark, d), _chunks).select(F.col("track").alias("s_suppkey"), tenth("integrated").alias("integrated_tenths"), tenth("short_term_max").alias("short_term_tenths"))


def sound_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tones between silences, rendered at three gains: bytes after the trim, frames after resampling as well, and the greatest sample."""

    @F.pandas_udf("binary")
    def made(key: pd.Series) -> pd.Series:
        def file(k: int) -> bytes:
            tone = 0.5 * np.sin(2 * np.pi * np.arange(RATE * (1 + k % 4)) / 8)
            wave = np.concatenate([np.zeros(RATE + k % 5 * 800), tone, np.zeros(RATE)]).astype(np.float32)
            return L.wav_bytes([wave, wave / 2], RATE)

        return pd.Series([file(int(k)) for k in key])

    @F.pandas_udf("int")
    def peak(content: pd.Series) -> pd.Series:
        return content.map(lambda c: int(np.abs(np.frombuffer(c, "<i2", offset=44).astype(np.int32)).max()))

    keys = load(spark, d, "supplier").filter("s_suppkey is not null").select("s_suppkey")
    tasks = max(1, -(-keys.count() // SOUNDS_A_TASK))  # one number
    sounds = keys.repartition(tasks).select("s_suppkey", made.asNondeterministic()("s_suppkey").alias("content"))
    gain = F.element_at(F.array(F.lit(-6.0), F.lit(0.0), F.lit(12.0)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    out = sounds.withColumn("wav", audio.rendered(F.col("content"), gain)).withColumn("again", audio.rendered(F.col("content"), gain, True, 44_100))
    frames = F.expr("(octet_length(again) - 44) div 4")
    return out.select("s_suppkey", F.octet_length("wav").cast("long").alias("n_bytes"), frames.cast("long").alias("frames"), peak("wav").alias("peak"))


QUERIES = {"sound_loudness": sound_loudness, "sound_lengths": sound_lengths}

_SHELF_HZ, _DB, _Q, _E = L.SHELF
_PASS_HZ, _PASS_Q = L.PASS
_POWER = lambda b, a: f"((({b[0]}) + ({b[1]}) * cos(w) + ({b[2]}) * cos(2 * w)) ** 2 + (({b[1]}) * sin(w) + ({b[2]}) * sin(2 * w)) ** 2) / ((1 + ({a[0]}) * cos(w) + ({a[1]}) * cos(2 * w)) ** 2 + (({a[0]}) * sin(w) + ({a[1]}) * sin(2 * w)) ** 2)"

#: DuckDB: the squared responses of both filters at a tone's pitch; a block's power by how much of it is loud; both gates.
ORACLE = {
    "sound_loudness": f"""
        WITH s AS (SELECT s_suppkey, 2 * pi() * (400 + s_suppkey % 10 * 200) / {RATE} AS w, 0.1::DOUBLE + s_suppkey % 10 * 0.05::DOUBLE AS loud FROM supplier),
        c AS (SELECT *, tan(pi() * {_SHELF_HZ}::DOUBLE / {RATE}) AS k, pow(10.0::DOUBLE, {_DB}::DOUBLE / 20) AS h, tan(pi() * {_PASS_HZ}::DOUBLE / {RATE}) AS k2 FROM s),
        n AS (SELECT *, pow(h, {_E}::DOUBLE) AS v, 1 + k / {_Q}::DOUBLE + k * k AS n1, 1 + k2 / {_PASS_Q}::DOUBLE + k2 * k2 AS n2 FROM c),
        r AS (SELECT s_suppkey, loud,
                     {_POWER((f"(h + v * k / {_Q}::DOUBLE + k * k) / n1", "2 * (k * k - h) / n1", f"(h - v * k / {_Q}::DOUBLE + k * k) / n1"), ("2 * (k * k - 1) / n1", f"(1 - k / {_Q}::DOUBLE + k * k) / n1"))}
                     * {_POWER(("1", "-2", "1"), ("2 * (k2 * k2 - 1) / n2", f"(1 - k2 / {_PASS_Q}::DOUBLE + k2 * k2) / n2"))} AS response FROM n),
        b AS (SELECT s_suppkey, b, 1.25::DOUBLE / 2 * response * (f * loud * loud + (1 - f) * {QUIET * QUIET}::DOUBLE) AS power
              FROM (SELECT *, least(1, greatest(0, (b + 4 - {QUIET_SECONDS * 10}) / 4.0::DOUBLE)) AS f FROM r, range({SECONDS * 10 - 3}) t(b))),
        l AS (SELECT *, {L.OFFSET} + 10 * log10(power) AS lufs FROM b),
        a AS (SELECT * FROM l WHERE lufs > {L.ABSOLUTE_GATE}),
        x AS (SELECT s_suppkey, -1 AS w, lufs, power FROM a UNION ALL SELECT s_suppkey, w, lufs, power FROM a, range({SECONDS - 2}) t(w) WHERE b >= w * 10 AND b + 4 <= w * 10 + 30),
        g AS (SELECT s_suppkey, w, {L.OFFSET} + 10 * log10(avg(power)) - {L.RELATIVE_GATE} AS gate FROM x GROUP BY ALL),
        v AS (SELECT s_suppkey, w, {L.OFFSET} + 10 * log10(avg(power)) AS value FROM x JOIN g USING (s_suppkey, w) WHERE lufs > gate GROUP BY ALL)
        SELECT s_suppkey, CAST(floor(max(value) FILTER (w = -1) * 10 + 0.5) AS BIGINT) AS integrated_tenths, CAST(floor(max(value) FILTER (w >= 0) * 10 + 0.5) AS BIGINT) AS short_term_tenths
        FROM v GROUP BY s_suppkey""",
    # From 50 ms before the second sample of the tone (its first is 0) to 300 ms after its last; 12 dB more meet the ceiling of -1 dB.
    "sound_lengths": f"""
        WITH s AS (SELECT s_suppkey, {RATE} * (1 + s_suppkey % 4) - 2 + {RATE} * 3 // 10 + {RATE} // 20 AS n FROM supplier)
        SELECT s_suppkey, CAST(44 + n * 4 AS BIGINT) AS n_bytes, CAST(floor(n * 44100.0::DOUBLE / {RATE} + 0.5) AS BIGINT) AS frames,
               CAST(floor(32767 * CASE s_suppkey % 3 WHEN 0 THEN 0.5::DOUBLE * pow(10.0::DOUBLE, -0.3::DOUBLE) WHEN 1 THEN 0.5::DOUBLE ELSE pow(10.0::DOUBLE, -0.05::DOUBLE) END + 0.5) AS INTEGER) AS peak
        FROM s""",
}
