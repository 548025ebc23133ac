"""A data source of the first bytes of files. Tasks open files and read a prefix each, never more; without the prefix
in the schema they open none.

    spark.dataSource.register(PrefixFiles)
    spark.read.format("prefix_files").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wavecrate.sources import audio
from wavecrate.sources import tags as tag_source
from wavecrate.sources.files import listed, opened

TASK_BYTES, OPEN_COST, BATCH_BYTES = 64 << 20, 64 << 10, 16 << 20  # read by a task; what opening a file counts as; of one Arrow batch


@dataclass
class Files(InputPartition):
    """What one task reads: paths and lengths."""

    files: list[tuple[str, int]]


class PrefixReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.most = options["path"], int(options.get("bytes", tag_source.PREFIX_BYTES))
        self.task_bytes, self.names = int(options.get("taskbytes", TASK_BYTES)), schema.names

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, as many to a task as their prefixes fill TASK_BYTES."""
        out, size = [Files([])], 0
        for info in listed(*opened(self.folder)):
            cost = min(info.size, self.most) + OPEN_COST
            if out[-1].files and size + cost > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].files.append((info.path, info.size))
            size += cost
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        kinds = {"path": pa.string(), "length": pa.int64(), "prefix": pa.binary()}
        rows, size = [], 0
        for path, length in partition.files:
            row = {"path": path, "length": length}
            if "prefix" in self.names:
                with system.open_input_file(path) as file:
                    row["prefix"] = file.read_at(min(self.most, length), 0)
                size += len(row["prefix"])
            rows.append(row)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds[n]) for n in self.names})
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds[n]) for n in self.names})


class PrefixFiles(DataSource):
    """path, length and prefix of all files below a folder; a schema of fewer columns reads less."""

    @classmethod
    def name(cls) -> str:
        return "prefix_files"

    def schema(self) -> str:
        return "path string, length long, prefix binary"

    def reader(self, schema: StructType) -> PrefixReader:
        return PrefixReader(self.options, schema)


def prefixes(spark: SparkSession, folder: str, columns: str = "path string, length long, prefix binary", most: int = tag_source.PREFIX_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The source with its columns chosen: what isn't named isn't read."""
    spark.dataSource.register(PrefixFiles)
    return spark.read.format("prefix_files").schema(columns).option("bytes", most).option("taskBytes", task_bytes).load(folder)


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Name, extension, length, state and tags of all files; only the prefixes of files are read."""
    files = prefixes(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    stated = audio.with_state(files)
    return stated.withColumn("tags", F.when(F.col("state") == "accepted", tag_source.tags(F.col("prefix"), F.col("extension")))).drop("prefix")
