"""Audio files as rows: scan, decode, analysis and rendering as Arrow functions, one row a file with its own error."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.functions import names as N
from wavecrate.functions import signal
from wavecrate.sources import tags as tag_source

# What is accepted.
EXTENSIONS, MAX_BYTES = (".mp3", ".wav", ".flac", ".m4a"), 500 * 1024 * 1024
KEY_RATE, FALLBACK_S = 22_050, 60
REMEMBERED = 4096  # analyses that a worker keeps
ANALYSIS = "bpm int, bpm_mode string, bpm_min double, bpm_max double, key string, key_confidence double, key_confident boolean, integrated double, short_term_max double, true_peak double, fallback_genre string, error string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder with name, extension, state (accepted, wrong_type, too_big) and the content of accepted ones.

    The content of files that are too big isn't read, as the filter on `length` is pushed into the scan; that of a wrong
    type neither, as rejects come from a scan without the column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = with_state(files.withColumn("name", F.element_at(F.split("path", "/"), -1)))
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in EXTENSIONS) + "}"
    right = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).filter(F.col("length") <= MAX_BYTES)
    right = with_state(right.withColumn("name", F.element_at(F.split("path", "/"), -1))).filter("state = 'accepted'")
    rejects = named.filter("state <> 'accepted'").withColumn("content", F.lit(None).cast("binary"))
    return right.unionByName(rejects)


def with_state(files: DataFrame) -> DataFrame:
    """Extension and state of rows with name and length."""
    state = F.when(~F.col("extension").isin(*EXTENSIONS), "wrong_type").when(F.col("length") > MAX_BYTES, "too_big").otherwise("accepted")
    return files.withColumn("extension", N.extension(F.col("name"))).withColumn("state", state)


def with_tags(files: DataFrame) -> DataFrame:
    """D8."""
    return files.withColumn("tags", tag_source.tags(F.col("content"), F.col("extension")))


def _analyse(content: bytes | None, with_true_peak: bool, with_genre: bool, with_music: bool = True, with_loudness: bool = True) -> dict:
    from wavecrate.functions import loudness

    try:
        channels, sr = loudness.wav_channels(bytes(content or b""))
        if not len(channels[0]):
            raise ValueError("no sound in the file")
    except (ValueError, IndexError) as problem:
        return {"error": str(problem)}
    out, mono = {}, loudness.downmix(channels, sr) if with_music or with_genre else None
    # Up to FALLBACK_S the genre hears what the tempo hears: one pass over the spectra serves both.
    shape = signal.Shape(sr) if with_music and with_genre and len(mono) <= FALLBACK_S * sr else None
    if with_music:
        tempo, key = signal.analyze_tempo(mono, sr, shape), signal.detect_key(loudness.resample([mono], sr, KEY_RATE)[0], KEY_RATE)
        out |= {"bpm": tempo["bpm"], "bpm_mode": tempo["mode"], "bpm_min": tempo["min"], "bpm_max": tempo["max"], "key": key["key"], "key_confidence": key["confidence"], "key_confident": key["confident"]}
    if with_loudness:
        out |= loudness.measure(channels, sr, with_true_peak)
    if with_genre:
        short = mono[: FALLBACK_S * sr]
        out["fallback_genre"] = signal.centroid_genre(short, sr, tempo["whole"] if shape else signal.detect_tempo(short, sr), shape)
    return out


_KNOWN: OrderedDict[tuple, dict] = OrderedDict()  # of this worker, by the BLAKE2 hash of a file and what was asked


def _analysis_once(content: bytes | None, *flags: bool) -> dict:
    """The analysis of a file; a copy, byte for byte, of one that this worker has analysed lately takes over its measures."""
    key = (hashlib.blake2b(content or b"", digest_size=32).digest(), *flags)
    found = _KNOWN.pop(key, None) or _analyse(content, *flags)
    _KNOWN[key] = found
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.popitem(last=False)
    return found


def analysis(content: Column, with_true_peak: bool = True, with_genre: bool = False, with_music: bool = True, with_loudness: bool = True) -> Column:
    """All measures of a WAV file in one pass; the flags leave out the dear ones (music: tempo and key). What fails has an error instead.

    Every file is read and hashed; copies of one file are measured once a worker.
    """

    @F.pandas_udf(ANALYSIS)
    def run(batch: pd.Series) -> pd.DataFrame:
        names = [p.split()[0] for p in ANALYSIS.split(", ")]
        rows = pd.DataFrame([_analysis_once(c, with_true_peak, with_genre, with_music, with_loudness) for c in batch], columns=names).astype(object)
        rows = rows.where(rows.notna(), None)
        return rows

    # Spark repeats a deterministic function for each projection that uses its result.
    return run.asNondeterministic()(content)


def rendered(content: Column, gain_db: Column, trim: bool = True, rate: int | None = None) -> Column:
    """Gain, limiter, trim and resampling of a WAV file, as WAV bytes (also where MP3 was wanted); null if it can't be read."""

    @F.pandas_udf("binary")
    def run(batch: pd.Series, gains: pd.Series) -> pd.Series:
        from wavecrate.functions import loudness as L

        out = []
        for c, g in zip(batch, gains, strict=True):
            try:
                channels, sr = L.wav_channels(bytes(c or b""))
            except (ValueError, IndexError):
                out.append(None)
                continue
            channels = L.limit(L.apply_gain(channels, 0.0 if pd.isna(g) else float(g)), sr)
            channels = L.trim_silence(channels, sr) if trim else channels
            channels = L.resample(channels, sr, rate) if rate else channels
            out.append(L.wav_bytes(channels, rate or sr))
        return pd.Series(out, dtype=object)

    return run.asNondeterministic()(content, gain_db)


def catalogue(results: DataFrame, order: str) -> DataFrame:
    """Output paths `folder/name`, unique, with each row's place in its folder; write with partitionBy("folder").

    Places are counted within buckets of the order and over them, so no task holds a whole folder. They come first, as
    they ask for the least and the greatest of the order, which is cheap only before the paths are made unique.
    """
    from wavecrate.operators.catalog import unique_paths
    from wavecrate.operators.events import positions

    placed = results.withColumn("folder", N.folder_name(F.col("genre"))).withColumn("path", F.concat("folder", F.lit("/"), N.safe_file_name(F.col("name"))))
    named = unique_paths(positions(placed, "folder", [order]), "path", order)
    return named.withColumn("place", (F.col("pos") + 1).cast("int")).drop("pos", "n")


def write_catalogue(results: DataFrame, path: str) -> None:
    """The files' bytes by folder under their unique paths; a folder a partition, no single archive in one task."""
    results.select("folder", F.col("unique_path").alias("output_path"), "content").write.mode("overwrite").partitionBy("folder").parquet(path)
