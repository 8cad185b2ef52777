"""Refresh: snapshots of files compared on a timer, and append-only streams of spans.

A file stream reads a path once, so a file that is rewritten or gone would not be
seen. The watch loop therefore compares snapshots in batch; a stream serves what is
only appended, such as trace exports.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import classify
from ..sources import otlp


def interval(files: int) -> int:
    """Seconds between looks: five, one more for each 500 files, sixty at most."""
    return min(60, 5 + files // 500)


class Watch:
    """Looks at a snapshot (project, rel_path, sha256, mtime_ns, size) and hands what
    changed to `apply`; one look at a time, others are skipped."""

    def __init__(self, snapshot: Callable[[], DataFrame], apply: Callable[[DataFrame], None], stored: DataFrame):
        self.snapshot, self.apply, self.stored = snapshot, apply, stored
        self.busy = threading.Lock()

    def look(self) -> bool:
        """Whether anything had changed; the new snapshot is kept when it is applied."""
        if not self.busy.acquire(blocking=False):
            return False
        try:
            current = self.snapshot()
            changes = classify(current, self.stored).where("status <> 'unchanged'")
            if changes.isEmpty():
                return False
            self.apply(changes)
            self.stored = current
            return True
        finally:
            self.busy.release()


def stream_spans(spark: SparkSession, path: str, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Span statistics of each batch of new export files, given to `apply`; a batch
    that is run again after a failure has the same number."""
    docs = spark.readStream.schema(otlp.SCHEMA).option("multiLine", "true").json(path)

    def batch(df: DataFrame, number: int) -> None:
        apply(otlp.span_stats(otlp.spans(df)), number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by window and type of a stream of events (ts, event_type, value)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
