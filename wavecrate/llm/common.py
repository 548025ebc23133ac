"""Helpers that the corpus operators share: table reading, the shared scratch folder, Arrow text access."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; the path may be one that only Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir().rstrip("/")


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. Results may be read from it until the driver ends, which deletes it."""
    if not _scratch:
        atexit.register(_clear)
    _scratch.append(f"{shared_dir(spark)}/wavecrate-{label}-{uuid.uuid4().hex}")
    return _scratch[-1]


def scratch_mark() -> int:
    """How much scratch there is; release() deletes what came later."""
    return len(_scratch)


def release(spark: SparkSession, mark: int, label: str) -> None:
    """Deletes the scratch made since the mark but for that of the label, once nothing reads it any more."""
    later = _scratch[mark:]
    for path in later:
        if f"/wavecrate-{label}-" not in path:
            drop_path(spark, path)
            _scratch.remove(path)


def _clear() -> None:
    """Deletes this driver's scratch, through Spark's file systems while the session lives, else as local files."""
    spark = SparkSession.getActiveSession()
    for path in _scratch:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; what isn't local is left to the folder's own clean-up
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file:").replace("//", "/"), ignore_errors=True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder as Parquet and reads it back, so lost executors cost no recomputation."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text: str = "text") -> F.Column:
    """Tells the texts of rows that share a doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that df has already, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_of(docs: DataFrame, stay: DataFrame, key: F.Column) -> DataFrame:
    """The rows of docs whose doc_id and key are those of a row (id, key) of stay; rows that repeat both all stay."""
    own, id_, key_ = free_names(docs, "__own", "__id", "__key")
    told = stay.select(F.col("id").alias(id_), F.col("key").alias(key_)).distinct()
    match = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key_))
    return docs.withColumn(own, key).join(told, match, "left_semi").drop(own)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def hash_limit(rows: int, sample: int) -> int:
    """A bound under which about twice `sample` of so many 64-bit hashes lie (and a margin), so that the lowest `sample` are found among few."""
    share = (2 * sample + 200) / max(1, rows)
    return (1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def text_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most `limit` bytes (one row at least) and 50,000 rows: first row, end row, bytes, offsets from 0."""
    raw, at = buffers(column)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1), lo + 50_000)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the public SplitMix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers, made from a rule."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
