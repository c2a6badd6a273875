"""How far jobs and streams are."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(NamedTuple):
    """Tasks of the running stages of a job group."""

    stages: int
    done: int
    total: int
    failed: int


def of_group(spark: SparkSession, group: str) -> Progress:
    tracker = spark.sparkContext.statusTracker()
    stages = done = total = failed = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s is not None:
                stages, done, total, failed = stages + 1, done + s.numCompletedTasks, total + s.numTasks, failed + s.numFailedTasks
    return Progress(stages, done, total, failed)


class Batches(StreamingQueryListener):
    """Remembers the last `most` batches of all streams: (name, batch, rows in, rows a second)."""

    def __init__(self, most: int = 100):
        self.most, self.batches, self.ended = most, [], []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.batches = [*self.batches, (p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)][-self.most :]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.append((str(event.id), event.exception))
