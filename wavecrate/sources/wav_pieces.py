"""A data source of the samples of WAV files in pieces: a long file is read by many tasks, each opening it at its own place.

    spark.read.format("wav_pieces").option("path", folder).load()   # path, channel, chunk, rate, samples, start
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wavecrate.sources.files import listed, opened

PIECE_BYTES, TASK_BYTES = 4 << 20, 64 << 20  # of a file in one row a channel; of a task


@dataclass
class Pieces(InputPartition):
    """Paths, and which piece of each."""

    pieces: list[tuple[str, int]]


def layout(file) -> tuple[int, int, int, int]:
    """Where the samples start, their bytes, channels and rate of a 16-bit PCM file, reading its chunks' heads alone; else ValueError."""
    head = file.read_at(12, 0)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, end = 12, None, file.size()
    while at + 8 <= end:
        name, size = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
        elif name == b"data" and form:
            if form[0] != 1 or form[5] != 16:
                raise ValueError("only 16-bit PCM is read")
            return at + 8, min(size, end - at - 8), form[1], form[2]
        at += 8 + size + size % 2
    raise ValueError("no sound in the file")


class PieceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.piece, self.task = options["path"], int(options.get("piecebytes", PIECE_BYTES)), int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Pieces]:
        pieces = [(f.path, k) for f in listed(*opened(self.folder)) if f.path.lower().endswith(".wav") for k in range(-(-f.size // self.piece))]
        each = max(1, self.task // self.piece)
        return [Pieces(pieces[k : k + each]) for k in range(0, max(1, len(pieces)), each)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        for path, k in partition.pieces:
            with system.open_input_file(path) as file:
                try:
                    start, size, channels, rate = layout(file)
                except (ValueError, struct.error):
                    continue
                frame = 2 * channels
                lo, hi = (min(size // frame, n * max(1, self.piece // frame)) for n in (k, k + 1))
                if lo < hi:
                    raw = np.frombuffer(file.read_at((hi - lo) * frame, start + lo * frame), "<i2").reshape(-1, channels)
                    samples = [pa.array([(raw[:, c] / 32768).astype(np.float32)], pa.list_(pa.float32())) for c in range(channels)]
                    yield pa.RecordBatch.from_pydict(
                        {"path": pa.array([path] * channels), "channel": pa.array(range(channels), pa.int32()), "chunk": pa.array([k] * channels, pa.int64()), "rate": pa.array([rate] * channels, pa.int32()), "samples": pa.concat_arrays(samples), "start": pa.array([lo] * channels, pa.int64())}
                    )


class WavPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_pieces"

    def schema(self) -> str:
        return "path string, channel int, chunk long, rate int, samples array<float>, start long"

    def reader(self, schema: StructType) -> PieceReader:
        return PieceReader(self.options)


def wav_pieces(spark: SparkSession, folder: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All samples of the WAV files below a folder; files that aren't 16-bit PCM have no rows."""
    spark.dataSource.register(WavPieces)
    return spark.read.format("wav_pieces").option("pieceBytes", piece_bytes).load(folder)
