"""T5: long work in groups that can be cancelled half way, with progress. Finished groups stay and aren't done again."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Progress:
    """Groups finished and to do, and of the running one the tasks finished and known."""

    done: int
    total: int
    tasks_done: int = 0
    tasks: int = 0


class Batch:
    """Runs `work` over groups of items, one Spark job a group, each committed as a table of its own below `out`.

    items: rows with `order`; a group is GROUP rows in that order. Groups that earlier runs finished are left out, so a
    run after a cancelled one goes on where it ended.
    """

    def __init__(self, items: DataFrame, order: str, work: Callable[[DataFrame], DataFrame], out: str, group: int = 1_000) -> None:
        self.spark: SparkSession = items.sparkSession
        self.items, self.order, self.work, self.out, self.size = items, order, work, out, group
        self.tag, self.cancelled = f"batch-{uuid.uuid4().hex}", threading.Event()
        self.current = Progress(0, 0)

    def _groups(self) -> list[tuple[int, object, object]]:
        """Number, first and last value of the order of each group, by evenly spaced values: two of each, not the rows."""
        n = self.items.count()
        k = -(-n // self.size)
        if not k:
            return []
        edges = self.items.agg(F.percentile(self.order, [i / k for i in range(k + 1)]).alias("e")).first()["e"]
        return [(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if lo < hi or i == k - 1 or k == 1]

    def _finished(self, number: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.out}/group={number}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def cancel(self) -> None:
        """Stops the running group's job and starts no other. What is finished stays."""
        self.cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)  # tags of the context are seen by all threads, those of the session by one

    def progress(self) -> Progress:
        """What is done now, with the tasks of the running job as the scheduler counts them."""
        tracker, done, known = self.spark.sparkContext.statusTracker(), 0, 0
        for stage in (s for j in tracker.getActiveJobsIds() if (info := tracker.getJobInfo(j)) for s in info.stageIds):
            if info := tracker.getStageInfo(stage):
                done, known = done + info.numCompletedTasks, known + info.numTasks
        return Progress(self.current.done, self.current.total, done, known)

    def run(self, told: Callable[[Progress], None] = lambda p: None) -> Progress:
        """Works off all groups that aren't finished; returns the final progress, less than total if it was cancelled."""
        groups = self._groups()
        finished = sum(self._finished(i) for i, _, _ in groups)
        self.current = Progress(finished, len(groups))
        told(self.current)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            for number, lo, hi in groups:
                if self.cancelled.is_set() or self._finished(number):
                    continue
                inside = (F.col(self.order) >= lo) & ((F.col(self.order) <= hi) if number == groups[-1][0] else (F.col(self.order) < hi))
                try:
                    self.work(self.items.filter(inside)).write.mode("overwrite").parquet(f"{self.out}/group={number}")
                except Exception:
                    if self.cancelled.is_set():  # the job was interrupted; its output was never committed
                        continue
                    raise
                self.current = Progress(self.current.done + 1, len(groups))
                told(self.current)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        return self.current

    def results(self) -> DataFrame:
        """The rows of all finished groups."""
        done = [f"{self.out}/group={i}" for i, _, _ in self._groups() if self._finished(i)]
        return self.spark.read.option("basePath", self.out).parquet(*done).drop("group")
