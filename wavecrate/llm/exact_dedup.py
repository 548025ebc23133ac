"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes meets a mask, so equal texts get equal chunks. Chunks are
reduced to distinct (hash, bytes) pairs before they are shuffled: every distinct chunk moves about once, however many
documents hold it. A hash with one byte string is a verified identifier; a hash with several gets an ordinal for each
byte string. Documents then compare only their ordered identifier lists, 8 bytes a chunk.

Defined results: a null text counts as empty; all empty texts are equal to one another; repeated rows are separate
members of a group; of equal texts the row with the largest doc_id stays (if rows share that id, each of them counts
as kept); a null doc_id is kept only in a group without other ids. Extra columns are ignored, an empty table gives an
empty result, and long texts need memory for one text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.llm.common import materialise, rows_of, seeds, table, text_slices

MASK_BITS, SMALLEST, LARGEST = 10, 256, 16_384
GEAR = (seeds(256, 1) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, ascending, and the number of chunks of each text."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):  # after these steps each value is a hash of the last 32 bytes
        wide = h.copy()
        wide[s:] += h[:-s] << np.uint32(s)
        h = wide
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    bounds = np.searchsorted(marks, at, "right")
    marks, bounds, ends, counts = marks.tolist(), bounds.tolist(), [], []
    starts = at.tolist()
    for k in range(len(starts) - 1):
        before, s, e = len(ends), starts[k], starts[k + 1]
        for m in marks[bounds[k] : bounds[k + 1]]:
            if m - s < SMALLEST:
                continue
            while m - s > LARGEST:
                s += LARGEST
                ends.append(s)
            if m > s:
                ends.append(m)
                s = m
        while e - s > LARGEST:
            s += LARGEST
            ends.append(s)
        if e > s:
            ends.append(e)
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def _signed(values: list[int], bits: int) -> np.ndarray:
    return (np.array(values, np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def _pieces(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends, counts = cut_points(data, at)
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    flat = offsets.tolist()
    return offsets, counts, _signed([digest(view[a:b]) for a, b in zip(flat, flat[1:], strict=False)], bits)


def _chunk_rows(bits: int, keys: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, data, at in text_slices(column):
                offsets, counts, ids = _pieces(data, at, bits)
                body = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                out = {"chunk_hash": pa.array(ids), "chunk": body}
                if keys:
                    doc = batch.column(batch.schema.get_field_index("row_key")).slice(lo, hi - lo)
                    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                    out["row_key"] = doc.take(pa.array(np.repeat(np.arange(hi - lo), counts)))
                    out["pos"] = pa.array((np.arange(len(ids)) - np.repeat(first, counts)).astype(np.int32))
                yield pa.RecordBatch.from_pydict(out)

    return rows


def _recipe_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            key = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, at in text_slices(column):
                _, counts, ids = _pieces(data, at, bits)
                view, flat = memoryview(np.ascontiguousarray(data)), at.tolist()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(flat, flat[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": key.slice(lo, hi - lo), "text_sha256": pa.array(digests), "recipe": lists})

    return rows


def clashes(docs: DataFrame, bits: int) -> DataFrame:
    """chunk_hash of each hash that stands for several byte strings. Chunks are made distinct before the shuffle."""
    distinct = docs.select("text").mapInArrow(_chunk_rows(bits, False), "chunk_hash long, chunk binary").distinct()
    return distinct.groupBy("chunk_hash").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_hash")


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and recipe, the ordered list of verified chunk identifiers (hash, ordinal)."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_sha256 string, recipe array<bigint>"
    found = clashes(docs, bits)
    plain = docs.select("doc_id", "text").mapInArrow(_recipe_rows(bits), kind)
    if found.isEmpty():
        return plain.withColumn("ordinals", F.array().cast("array<int>"))
    # Rare: several byte strings share a hash. Their occurrences get the ordinal of their own byte string.
    spelt = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("row_key"), "text")
    uses = spelt.mapInArrow(_chunk_rows(bits, True), f"chunk_hash long, chunk binary, row_key {spelt.schema['row_key'].dataType.simpleString()}, pos int")
    uses = uses.join(found, "chunk_hash", "left_semi")
    names = uses.select("chunk_hash", "chunk").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("chunk_hash").orderBy("chunk")) - 1)
    told = uses.join(names, ["chunk_hash", "chunk"]).select("row_key", "pos", "ordinal").distinct()
    told = told.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))).alias("marks"))
    told = told.select(F.col("row_key.sha").alias("text_sha256"), F.col("marks").getField("ordinal").alias("ordinals")).dropDuplicates(["text_sha256"])
    return plain.join(told, "text_sha256", "left").withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<int>"))).select("doc_id", "text_sha256", "recipe", "ordinals")


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    made = materialise(recipes(docs, bits), "recipes")
    groups = materialise(made.groupBy("recipe", "ordinals").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    # Groups are one row each, written first: only joins right above two exchanges have their large partitions split.
    joined = made.join(groups.hint("merge"), ["recipe", "ordinals"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: of each text that with the largest doc_id; rows that repeat both all stay."""
    stay = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"))
    return rows_of(docs, stay, F.sha2(F.coalesce("text", F.lit("")), 256))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}

#: DuckDB: equal texts share a group; the largest id stays. Text hashes stand for the texts in the window.
ORACLE = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (body)
    """
}
