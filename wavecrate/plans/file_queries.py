"""Queries over files that Spark's tasks compose from the tables: tags from prefixes, and ZIP archives written and read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.sources import archive, audio, prefixes
from wavecrate.sources.files import opened
from wavecrate.sources.tables import load, shared_path, spread


def id3_bytes(version: int, encoding: int, artist: str, title: str, genre: str) -> bytes:
    """ID3v2.2, 2.3 or 2.4 with text frames of one encoding: 0 Latin-1, 1 UTF-16 with a mark, 2 UTF-16 big-endian, 3 UTF-8."""
    coded = {0: lambda t: t.encode("latin-1"), 1: lambda t: b"\xff\xfe" + t.encode("utf-16-le"), 2: lambda t: t.encode("utf-16-be"), 3: lambda t: t.encode()}[encoding]
    seven = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    frames = b""
    for long, short, text in (("TPE1", "TP1", artist), ("TIT2", "TT2", title), ("TCON", "TCO", genre)):
        body = bytes([encoding]) + coded(text)
        frames += short.encode() + len(body).to_bytes(3, "big") + body if version == 2 else long.encode() + (seven(len(body)) if version == 4 else len(body).to_bytes(4, "big")) + b"\0\0" + body
    return b"ID3" + bytes([version, 0, 0]) + seven(len(frames)) + frames


def flac_bytes(artist: str, title: str, genre: str) -> bytes:
    """A stream of one padding block and one comment block."""
    pairs = [f"artist={artist}", "COMMENT=none", f"TITLE={title}", f"Genre={genre}"]
    comments = struct.pack("<I", 4) + b"made" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p.encode())) + p.encode() for p in pairs)
    block = lambda kind, body: bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"fLaC" + block(1, bytes(64)) + block(128 | 4, comments)


def mp4_bytes(artist: str, title: str, genre_number: int) -> bytes:
    """Atoms down to a tag with a numbered genre."""
    atom = lambda name, body: struct.pack(">I", 8 + len(body)) + name.encode("latin-1") + body
    value = lambda kind, body: atom("data", struct.pack(">II", kind, 0) + body)
    tag = atom("ilst", atom("©nam", value(1, title.encode())) + atom("©ART", value(1, artist.encode())) + atom("gnre", value(0, struct.pack(">H", genre_number))))
    return atom("ftyp", b"M4A ") + atom("moov", atom("udta", atom("meta", bytes(4) + tag)))


LAYOUTS = 8  # by key: three versions of ID3 in four encodings, FLAC, MP4, a file of the wrong kind and one without tags


def _layout(key: int, name: str) -> tuple[str, bytes]:
    """Extension and bytes of a supplier's file."""
    title = f"Café {key}"
    return {
        0: lambda: (".mp3", id3_bytes(2, 0, name, title, "(17)")),
        1: lambda: (".mp3", id3_bytes(3, 1, name, title, "(17)Hard Trance")),
        2: lambda: (".mp3", id3_bytes(4, 2, name, title, "35")),
        3: lambda: (".MP3", id3_bytes(4, 3, name, title, "Techno")),
        4: lambda: (".flac", flac_bytes(name, title, "Deep House")),
        5: lambda: (".m4a", mp4_bytes(name, title, 36)),
        6: lambda: (".txt", title.encode()),
        7: lambda: (".wav", b"RIFF" + bytes(40)),
    }[key % LAYOUTS]()


def prefix_tags(spark: SparkSession, d: str) -> DataFrame:
    """A file for each supplier, in eight layouts; every fiftieth is longer than the prefix. Only prefixes are read."""
    path = shared_path(spark, "files")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = opened(path)
        for batch in batches:
            for key, name in zip(batch["s_suppkey"], batch["s_name"], strict=True):
                extension, content = _layout(int(key), name)
                system.create_dir(f"{root}/{key % 10}", recursive=True)
                with system.open_output_stream(f"{root}/{key % 10}/{key}{extension}") as out:
                    out.write(content + bytes(600_000 if key % 50 == 0 else 1_000))
            yield pd.DataFrame({"n": [len(batch)]})

    load(spark, d, "supplier").select("s_suppkey", "s_name").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    found = prefixes.tagged(spark, path)
    return found.select(F.regexp_extract("name", "^[0-9]+", 0).cast("long").alias("s_suppkey"), "extension", "state", "tags.genre", "tags.artist", "tags.title")


FILES_A_TASK = 50_000
SHARD = 128  # files of an archive, so that each folder has several


def zip_archives(spark: SparkSession, d: str) -> DataFrame:
    """Parts as finished files in five folders, where names repeat; archives by runs of places, written and read back."""
    folders = F.element_at(F.array(*map(F.lit, ("House", "R&B", "Drum & Bass", "Pop", "Techno"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    part = spread(load(spark, d, "part").select("p_partkey", "p_name", "p_type"), FILES_A_TASK).select("p_partkey", folders.alias("genre"), F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(".mp3")).alias("name"), F.encode(F.concat_ws("|", "p_partkey", "p_name", "p_type"), "utf-8").alias("content"))
    placed = audio.catalogue(part, "p_partkey").select("folder", "place", F.col("unique_path").alias("output_path"), "content")
    path = shared_path(spark, "archives")
    archive.write_archives(placed, path, SHARD)
    return archive.read_archives(spark, path, "archive string, output_path string, length long, md5 string")


QUERIES = {f.__name__: f for f in (prefix_tags, zip_archives)}

ORACLE = {
    "prefix_tags": """
        WITH s AS (SELECT s_suppkey, s_name, s_suppkey % 8 AS k FROM supplier)
        SELECT s_suppkey, CASE k WHEN 4 THEN '.flac' WHEN 5 THEN '.m4a' WHEN 6 THEN '.txt' WHEN 7 THEN '.wav' ELSE '.mp3' END AS extension, CASE k WHEN 6 THEN 'wrong_type' ELSE 'accepted' END AS state,
               CASE k WHEN 0 THEN 'Rock' WHEN 1 THEN 'Hard Trance' WHEN 2 THEN 'House' WHEN 3 THEN 'Techno' WHEN 4 THEN 'Deep House' WHEN 5 THEN 'House' END AS genre,
               CASE WHEN k < 6 THEN s_name END AS artist, CASE WHEN k < 6 THEN 'Café ' || s_suppkey END AS title
        FROM s""",
    "zip_archives": f"""
        WITH p AS (SELECT p_partkey, ['House', 'R&B', 'Drum & Bass', 'Pop', 'Techno'][p_partkey % 5 + 1] AS folder, split_part(p_name, ' ', 1) AS stem, concat_ws('|', p_partkey, p_name, p_type) AS content FROM part),
        n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY p_partkey) AS place, row_number() OVER (PARTITION BY folder, stem ORDER BY p_partkey) AS k FROM p)
        SELECT folder || '-' || lpad(CAST((place - 1) // {SHARD} AS VARCHAR), 5, '0') || '.zip' AS archive, folder || '/' || stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.mp3' AS output_path,
               strlen(content)::BIGINT AS length, md5(content) AS md5
        FROM n""",
}
