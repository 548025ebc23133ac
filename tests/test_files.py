"""Prefix reads of sparse files, and archives written by tasks that fail on purpose."""

import os
import struct
import time
import zipfile
from types import SimpleNamespace

import pytest

from wavecrate.sources import archive, prefixes
from wavecrate.sources import tags as tag_source


def id3(artist, title, padding=0):
    frames = b"".join(struct.pack(">4sIH", n, len(v) + 1, 0) + b"\x03" + v for n, v in ((b"TPE1", artist), (b"TIT2", title))) + bytes(padding)
    size = len(frames)
    return b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frames


def test_a_terabyte_of_sparse_files(spark, tmp_path):
    """Files of 256 GB that hold nothing but their tags: whole reads couldn't end."""
    for k in range(4):
        with open(tmp_path / f"t{k}.mp3", "wb") as f:
            f.write(id3(f"artist {k}".encode(), f"title {k}".encode(), 600_000 * (k % 2)))
            f.truncate(256 << 30)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.txt").write_bytes(b"no sound")
    began = time.time()
    read = prefixes.prefixes(spark, str(tmp_path)).selectExpr("path", "length", "octet_length(prefix) AS n").collect()
    assert sorted((r.length, r.n) for r in read) == [(8, 8)] + [(256 << 30, tag_source.PREFIX_BYTES)] * 4
    got = {r["name"]: r for r in prefixes.tagged(spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    assert got["note.txt"].state == "wrong_type" and got["note.txt"].tags is None
    assert got["t1.mp3"].state == "too_big"


def test_tags_equal_the_whole_read(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.mp3").write_bytes(id3(f"artist {k}".encode(), f"title {k}".encode(), 700_000 * (k % 2)) + os.urandom(900_000))
    got = {r["name"]: tuple(r.tags) for r in prefixes.tagged(spark, str(tmp_path)).collect()}
    assert got == {f"{k}.mp3": tuple(tag_source.read_tags((tmp_path / f"{k}.mp3").read_bytes(), ".mp3")) for k in range(5)}


def test_columns_and_tasks(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.mp3").write_bytes(bytes(1000))
    names = prefixes.prefixes(spark, str(tmp_path), "path string, length long")
    (tmp_path / "0.mp3").chmod(0)  # opened by nobody
    assert names.agg({"length": "sum"}).first()[0] == 6000
    (tmp_path / "0.mp3").chmod(0o644)
    assert prefixes.prefixes(spark, str(tmp_path), task_bytes=2 * (prefixes.OPEN_COST + 1000)).rdd.getNumPartitions() == 3
    (tmp_path / "none").mkdir()
    assert prefixes.prefixes(spark, str(tmp_path / "none")).collect() == []


ROWS = [("House", k, f"House/{k}.mp3", os.urandom(50 + k)) for k in range(1, 1301)] + [("R&B", 1, "R&B/ü.mp3", b"x" * 100_000), ("Empty", 1, "Empty/e.mp3", b"")]
SCHEMA = "folder string, place int, output_path string, content binary"


def test_archives_hold_what_was_written(spark, tmp_path):
    out = tmp_path / "out"
    archive.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(3), str(out))
    names = sorted(p.name for p in out.iterdir())
    assert names == ["Empty-00000.zip", "House-00000.zip", "House-00001.zip", "House-00002.zip", "R&B-00000.zip", "_archives.json"]
    held = {}
    for p in out.glob("*.zip"):
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None
            if p.name.startswith("House-00001"):
                assert z.namelist() == [f"House/{k}.mp3" for k in range(513, 1025)]
            held |= {n: z.read(n) for n in z.namelist()}
            assert archive.archive_name(p.name) == next(iter(z.namelist())).split("/")[0]
    assert held == {path: content for _, _, path, content in ROWS}
    read = archive.read_archives(spark, str(out), "output_path string, content binary").collect()
    assert {r.output_path: bytes(r.content) for r in read} == held


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    out = tmp_path / "out"
    bad = F.when(F.col("output_path") == "R&B/ü.mp3", F.raise_error(F.lit("on purpose")).cast("binary")).otherwise(F.col("content"))
    frame = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(Exception, match="on purpose"):
        archive.write_archives(frame.withColumn("content", bad), str(out))
    assert [str(p) for p in out.rglob("*.zip")] == []


def test_a_failed_and_repeated_task_counts_once(tmp_path):
    """Two attempts of a task: the first stops half way, the second's archives alone are committed."""
    writer = archive.ArchiveWriter({"path": str(tmp_path)})
    rows = [{"shard": f"A-{k // 3:05}", "output_path": f"A/{k}.mp3", "content": bytes([k])} for k in range(7)]

    def stops():
        yield from rows[:5]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(stops())
    writer.commit([writer.write(iter(rows)), writer.write(iter([])), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["A-00000.zip", "A-00001.zip", "A-00002.zip", "_archives.json"]
    held = [n for p in sorted(tmp_path.glob("*.zip")) for n in zipfile.ZipFile(p).namelist()]
    assert held == [r["output_path"] for r in rows]


def test_a_task_reads_several_archives(tmp_path, monkeypatch):
    """Small archives share a task up to a number and a size; one that is larger has a task of its own, and none is left out."""
    for k in range(130):
        (tmp_path / f"A-{k:05}.zip").write_bytes(bytes(1_000 if k != 100 else 3_000_000))
    monkeypatch.setattr(archive, "TASK_BYTES", 1_000_000)
    tasks = archive.ArchiveReader({"path": str(tmp_path)}, SimpleNamespace(names=["archive"])).partitions()
    assert [len(t.paths) for t in tasks] == [64, 36, 1, 29]
    assert [p[-9:-4] for t in tasks for p in t.paths] == [f"{k:05}" for k in range(130)]
