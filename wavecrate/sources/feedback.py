"""Correction entries: validation of incoming JSON, the append-only store, and the client's log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.functions.names import trimmed

# Limits of one delivery and of one field.
MAX_BYTES, MAX_ENTRIES, MAX_TEXT = 256 * 1024, 200, 500
ENTRY = "v INT, at STRING, file STRING, artist STRING, title STRING, detected STRING, detectedSource STRING, corrected STRING, bpm DOUBLE, key STRING"
TEXTS = ("file", "artist", "title", "detected", "detectedSource", "corrected", "key")


def clamped(text: Column) -> Column:
    """Trimmed; empty is null; 500 characters at most."""
    return F.left(F.nullif(trimmed(text), F.lit("")), F.lit(MAX_TEXT))


def finite(value: Column) -> Column:
    """Null unless a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def validated(entries: DataFrame) -> DataFrame:
    """Clean fields; entries without a correction are dropped."""
    out = entries.withColumns({c: clamped(F.col(c)) for c in TEXTS}).withColumn("bpm", finite(F.col("bpm")))
    return out.filter("corrected is not null")


def deliveries(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Status of each JSON delivery (200, 400 malformed, 413 too large) and its entries, one object standing for a list of one."""
    text = F.col(body)
    wrapped = F.when(trimmed(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    good = F.try_parse_json(text).isNotNull() & trimmed(text).rlike(r"^[\[{]")
    entries = F.from_json(wrapped, f"array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in ENTRY.split(','))}>>")
    status = F.when(F.octet_length(text) > MAX_BYTES, 413).when(~good, 400).when(F.size(entries) > MAX_ENTRIES, 413).otherwise(200)
    return bodies.withColumn("status", status).withColumn("entries", F.when(F.col("status") == 200, entries))


def append(entries: DataFrame, store: str, invite: str | None = None) -> None:
    """Adds validated entries to the append-only store with the time of receipt."""
    validated(entries).withColumn("received_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).withColumn("invite", F.lit(invite).cast("string")).write.mode("append").parquet(store)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """The client's JSON log; lines that can't be read are left out."""
    raw = spark.read.schema(f"{ENTRY}, sent BOOLEAN, _broken STRING").option("columnNameOfCorruptRecord", "_broken").json(path)
    return raw.filter("_broken is null").drop("_broken")


def export_log(log: DataFrame, path: str) -> None:
    """S23."""
    log.write.mode("overwrite").json(path)


def count(log: DataFrame) -> int:
    """How many entries the log holds."""
    return log.count()


def clear(spark: SparkSession, path: str) -> None:
    """Leaves an empty log."""
    spark.createDataFrame([], f"{ENTRY}, sent BOOLEAN").write.mode("overwrite").json(path)
