"""Streams: failure counts in sliding windows with a watermark, and an at-least-once queue of corrections.

Event-time windows and late rows go beyond what the batch rules ask for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wavecrate.operators.events import unsent
from wavecrate.sources.feedback import MAX_ENTRIES


def failure_counts(failures: DataFrame, key: str, at: str, window: str = "15 minutes", slide: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Failures of a key in each sliding window; state older than the watermark is dropped."""
    return failures.withWatermark(at, late).groupBy(F.window(at, window, slide), key).agg(F.count("*").alias("n"), F.min(at).alias("oldest"))


def drain(queued: Callable[[], DataFrame], key: str, acknowledged: Callable[[], DataFrame], order: list[str], send: Callable[[DataFrame], None]) -> int:
    """Sends what isn't acknowledged, oldest first, MAX_ENTRIES at a time, until nothing is left or a send brings no acknowledgement.

    Returns how many entries remain; a later call takes them up again, so an entry may be sent twice but is never lost.
    """
    left = unsent(queued(), acknowledged(), key, order, None).count()
    while left:
        send(unsent(queued(), acknowledged(), key, order, MAX_ENTRIES))
        before, left = left, unsent(queued(), acknowledged(), key, order, None).count()
        if left >= before:
            break
    return left


def deliver(queue: DataFrame, key: str, acknowledged: Callable[[], DataFrame], order: list[str], send: Callable[[DataFrame], None], store: str, checkpoint: str) -> StreamingQuery:
    """Keeps new entries in the table `store` and drains it; what earlier runs left goes first.

    A batch that is run again overwrites its own part of the store, so no entry is queued twice.
    """
    spark, schema = queue.sparkSession, queue.schema

    def queued() -> DataFrame:
        return spark.read.schema(schema).parquet(store)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        drain(queued, key, acknowledged, order, send)

    spark.createDataFrame([], schema).write.mode("append").parquet(f"{store}/batch=-1")  # the store exists from the start
    drain(queued, key, acknowledged, order, send)
    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
