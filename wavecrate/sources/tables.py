"""Table access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns are pushed into the scan by the optimizer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, a_task: int) -> DataFrame:
    """The rows of a table dealt over tasks of a_task rows, for work that is dear by row: a small file would be one task."""
    return rows.repartition(max(1, -(-rows.count() // a_task)))  # one number


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/wavecrate-{label}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: made once, however often they are read. Columns without a type aren't written."""
    path, schema, names = shared_path(rows.sparkSession, label), rows.schema, rows.columns
    empty = {f.name: F.lit(None) for f in schema if f.dataType.typeName() == "void"}
    rows.drop(*empty).write.parquet(path)
    return rows.sparkSession.read.schema(rows.drop(*empty).schema).parquet(path).withColumns(empty).select(*[F.col(f"`{n}`") for n in names])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that df has already, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(df: DataFrame, **named: str) -> DataFrame:
    """Whole rows as one column `row`, beside columns under names of our own: nothing of the table can clash with what is added."""
    return df.select(F.struct("*").alias("row"), *[F.col(c).alias(name) for name, c in named.items()])


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns of packed rows, and more of those beside them, which replace columns of their name."""
    return df.select(*[F.col("row")[c].alias(c) for c in columns if c not in more], *more)
