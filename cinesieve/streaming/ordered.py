"""Greedy deduplication of a stream of frames that arrive out of order, with the result of the batch operator.

A frame waits in state until the watermark has passed its time: no earlier one can come any more, so its order is final. An
event-time timer a video, at its earliest waiting frame, then lets the waiting frames up to the watermark through in their
order. Kept hashes are a list in RocksDB that only grows by what a trigger keeps; the waiting list is written again, and is as
long as the delay allows. What arrives in which trigger makes no difference as long as no frame is later than the delay;
Spark drops later ones and counts them (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cinesieve.operators.dedup import HashState

OUTPUT = "video long, frame_order long, disposition string, similarity double"
WAITING, KEPT = "t long, frame_order long, item binary", "item binary"
_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Dedup(StatefulProcessor):
    def __init__(self, threshold: float, bits: int):
        self.threshold, self.bits = threshold, bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting, self.kept = handle, handle.getListState("waiting", WAITING), handle.getListState("kept", KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        arrived, unread = [], []
        for r in rows:
            if r.item is not None:
                arrived.append((r.t_ms, r.frame_order, bytes(r.item)))
            elif r.frame_order is not None:
                unread.append(r.frame_order)
        if arrived:
            self.waiting.appendList(arrived)
            earliest, timers = min(a[0] for a in arrived), list(self.handle.listTimers())
            if not timers or earliest < min(timers):
                self.handle.registerTimer(earliest)
        for order in unread:
            yield Row(video=key[0], frame_order=order, disposition="hash_error", similarity=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        due = [w for w in waiting if w[0] <= now]
        later = waiting[len(due) :]
        if not due:
            return
        held = HashState(self.threshold, self.bits)
        for (item,) in self.kept.get() if self.kept.exists() else ():
            held.add(bytes(item))
        kept = []
        for _, order, item in due:
            found = held.offer(bytes(item))
            if found is None:
                kept.append((bytes(item),))
            yield Row(video=key[0], frame_order=order, disposition="unique" if found is None else "duplicate", similarity=found)
        if kept:
            self.kept.appendList(kept)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def greedy(stream: DataFrame, threshold: float, bits: int = 256, delay: str = "10 seconds") -> DataFrame:
    """stream (video long, frame_order long, item binary, t timestamp) -> video, frame_order, disposition, similarity, in append mode.

    A video's frames are taken by their time in milliseconds, then by frame_order and item. Null items come out as hash_error
    at once; a row without an item and a frame_order only moves the clock, and gives none. Rows wait until the clock of the
    whole stream is `delay` past them, so that a stream that ends needs such a row to let the last frames through.
    """
    timed = stream.select("video", "frame_order", "item", "t", F.unix_millis("t").alias("t_ms")).withWatermark("t", delay)
    return timed.groupBy("video").transformWithState(_Dedup(threshold, bits), OUTPUT, "append", "eventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which lists and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
