"""Results as ZIP archives through a data source writer with a commit step, and a source that reads them.

Each archive holds one run of a folder's files (stored, CRC-32, central directory), written by one task to a name of its
own in a folder of the job. Only what committed tasks report is moved to its final name; what failed, stopped or doubled
tasks left goes with the job's folder. So no archive is ever half written, and no task holds more than a file.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from wavecrate.sources.files import listed, opened

FILES_A_SHARD = 512  # files of one archive
BATCH_BYTES = 16 << 20  # of one Arrow batch of contents
BATCH_ROWS = 10_000
ARCHIVES_A_TASK, TASK_BYTES = 64, 64 << 20  # that one task reads; a larger archive is a task of its own
EPOCH = (1980, 1, 1, 0, 0, 0)  # every entry's time, so that the same files give the same bytes
PENDING = "_pending"


@dataclass
class Shards(WriterCommitMessage):
    """What a task wrote: (temporary path, final path, files, bytes) of each archive."""

    written: list[tuple[str, str, int, int]]


class ArchiveWriter(DataSourceWriter):
    """Rows (shard, output_path, content), each shard's in one task and together."""

    def __init__(self, options: dict) -> None:
        self.folder, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Shards:
        system, root = opened(self.folder)
        system.create_dir(f"{root}/{PENDING}-{self.job}", recursive=True)
        written, shard, stream, archive = [], None, None, None

        def closed() -> None:
            if archive is not None:
                archive.close()
                written[-1] = (*written[-1][:2], len(archive.filelist), stream.tell())
                stream.close()

        for row in iterator:
            if row["shard"] != shard:
                closed()
                shard = row["shard"]
                place = f"{root}/{PENDING}-{self.job}/{uuid.uuid4().hex}.zip"
                written.append((place, f"{root}/{shard}.zip", 0, 0))
                stream = system.open_output_stream(place)
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
            archive.writestr(zipfile.ZipInfo(row["output_path"], EPOCH), bytes(row["content"] or b""))
        closed()
        return Shards(written)

    def commit(self, messages: list) -> None:
        system, root = opened(self.folder)
        done = [w for m in messages if m is not None for w in m.written]
        for place, final, _, _ in done:
            system.move(place, final)
        self._clear(system, root)
        with system.open_output_stream(f"{root}/_archives.json") as out:  # a row an archive, not a file
            out.write(json.dumps([{"archive": f[len(root) + 1 :], "files": n, "bytes": size} for _, f, n, size in sorted(done, key=lambda w: w[1])]).encode())

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        """Deletes the job's own folder with all that wasn't moved out of it."""
        if system.get_file_info(f"{root}/{PENDING}-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{PENDING}-{self.job}")


@dataclass
class Archives(InputPartition):
    paths: list[str]


class ArchiveReader(DataSourceReader):
    """Archives by the task, up to ARCHIVES_A_TASK or TASK_BYTES; a file's content is only read if a column needs it."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.names = options["path"], schema.names

    def partitions(self) -> list[Archives]:
        system, root = opened(self.folder)
        tasks, size = [], 0
        for f in listed(system, root):
            if f.path.endswith(".zip") and f"/{PENDING}-" not in f.path:
                if not tasks or len(tasks[-1].paths) == ARCHIVES_A_TASK or size + f.size > TASK_BYTES:
                    tasks.append(Archives([]))
                    size = 0
                tasks[-1].paths.append(f.path)
                size += f.size
        return tasks

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.folder)
        kinds = {"archive": pa.string(), "output_path": pa.string(), "length": pa.int64(), "crc": pa.int64(), "md5": pa.string(), "content": pa.binary()}
        batch = lambda rows: pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds[n]) for n in self.names})
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                for info in archive.infolist():
                    row = {"archive": path[len(root) + 1 :], "output_path": info.filename, "length": info.file_size, "crc": info.CRC}
                    if {"md5", "content"} & set(self.names):
                        row["content"] = archive.read(info)  # checks the CRC
                        row["md5"] = hashlib.md5(row["content"]).hexdigest()
                    rows.append({n: row[n] for n in self.names})
                    size += len(row["content"]) if "content" in self.names else 0
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, size = [], 0
        yield batch(rows)


class ZipArchives(DataSource):
    """Written from shard, output_path and content; read as archive, output_path, length, crc, md5 and content."""

    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def schema(self) -> str:
        return "archive string, output_path string, length long, crc long, md5 string, content binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def write_archives(results: DataFrame, path: str, files: int = FILES_A_SHARD) -> None:
    """Archives `folder-00000.zip`, ... of rows (folder, place, output_path, content), `files` files each in the order of places (from 1).

    A folder's rows are dealt out by runs of places, so a folder that holds most files is still written by many tasks.
    """
    results.sparkSession.dataSource.register(ZipArchives)
    run = F.expr(f"(place - 1) div {files}")
    shard = F.concat(F.regexp_replace("folder", r"[\\/]", "_"), F.lit("-"), F.lpad(run.cast("string"), 5, "0"))
    rows = results.select(shard.alias("shard"), "place", "output_path", "content").repartition("shard").sortWithinPartitions("shard", "place")
    rows.select("shard", "output_path", "content").write.format("zip_archives").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: str = "archive string, output_path string, length long, crc long, md5 string") -> DataFrame:
    """What the archives hold; contents are only read for md5 and content."""
    spark.dataSource.register(ZipArchives)
    return spark.read.format("zip_archives").schema(columns).load(path)


def archive_name(path: str) -> str:
    """The folder's part of an archive's name."""
    return re.sub(r"-[0-9]{5,}\.zip\Z", "", path)
