"""Change-driven refresh with Structured Streaming, and event windows as an extension."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.incremental import VersionedState, advance

# Pending paths beyond which everything is refreshed, and the longest wait of the reference's queue.
MOST_PENDING, MAX_WAIT_S = 1000, 2


def refresh(stream: DataFrame, state: VersionedState, apply: Callable[[DataFrame, int, bool], None], *, key: str, stamp: list[str], hash_: str, checkpoint: str, wait_s: float = MAX_WAIT_S, available_now: bool = False) -> StreamingQuery:
    """Run ``apply(changed, batch, full)`` for each micro-batch with the records that are new or changed.

    One batch is active at a time. A batch with over ``MOST_PENDING`` changed records asks for a full
    refresh. The runs of the state are the batch numbers together with what a batch holds, so a batch that the engine
    repeats after a failure applies nothing twice to the state and hands over the same changes again,
    and a stream with a new checkpoint, which counts from 0 again, applies its batches as new ones.
    """

    def batch(df: DataFrame, number: int) -> None:
        changed = advance(state, df.select(key, *stamp, hash_), number, key, stamp, hash_, reuse="apply")
        full = changed.limit(MOST_PENDING + 1).count() > MOST_PENDING
        apply(changed, number, full)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{max(wait_s, MAX_WAIT_S)} seconds")
    return writer.start()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; events later than ``late`` are dropped on a stream. An extension."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        windowed = windowed.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return windowed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap. An extension."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class ChangeQueue:
    """Changed paths that wait for a refresh.

    Paths that come within ``debounce`` seconds of one another go together, but none waits longer than
    the greater of that and MAX_WAIT_S. One batch is active at a time. Beyond MOST_PENDING waiting paths
    those of the lowest priority would go first; as a refresh without them would be wrong, everything is refreshed (``*``).
    """

    def __init__(self, debounce: float = 0.5, most: int = MOST_PENDING, clock: Callable[[], float] = time.monotonic):
        self.debounce, self.longest, self.most, self.clock = debounce, max(debounce, MAX_WAIT_S), most, clock
        self.pending: dict[str, int] = {}
        self.first = self.last = 0.0
        self.active = self.everything = False

    def add(self, path: str, priority: int = 0) -> None:
        now = self.clock()
        if not self.pending and not self.everything:
            self.first = now
        self.last = now
        if self.everything:
            return
        self.pending[path] = max(priority, self.pending.get(path, priority))
        if len(self.pending) > self.most:
            self.pending, self.everything = {}, True

    def take(self) -> list[str] | None:
        """The next batch, paths of higher priority first, ``["*"]`` for everything; None while there is nothing or it is too early."""
        now = self.clock()
        waiting = bool(self.pending) or self.everything
        if self.active or not waiting or (now - self.last < self.debounce and now - self.first < self.longest):
            return None
        batch = ["*"] if self.everything else sorted(self.pending, key=lambda p: (-self.pending[p], p))
        self.pending, self.everything, self.active = {}, False, True
        return batch

    def done(self, failed: list[str] | None = None) -> None:
        """The active batch has ended; what failed waits again."""
        self.active = False
        for path in failed or []:
            if path == "*":
                self.pending, self.everything, self.first, self.last = {}, True, self.clock(), self.clock()
            else:
                self.add(path)


class Progress(StreamingQueryListener):
    """The last events of all streams as plain records; ``spark.streams.addListener(Progress())``."""

    def __init__(self, keep: int = 100):
        self.events: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        self.events.append({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.events.append({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self.events.append({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.events.append({"event": "failed" if event.exception else "complete", "id": str(event.id)})
