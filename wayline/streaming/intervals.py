"""The interval join of a stream by each sequence's own clock, with state by time, idle timers and late rows kept apart.

Needs the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["seq_id", "us", "start_us", "samples", "late"]
SCHEMA = "seq_id long, us long, start_us long, samples array<long>, late boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """Lets queries that are started from now on keep their state in RocksDB."""
    spark.conf.set(PROVIDER, ROCKSDB)


class Intervals(StatefulProcessor):
    """Per sequence: samples in buckets of time, so that a batch reads and writes only the buckets it touches; frames
    that wait; and newest time, last frame put out and number of samples held."""

    def __init__(self, delay: int, span: int, idle: int | None, most: int | None, ttl: int | None):
        self.delay, self.span, self.idle, self.most, self.ttl = delay, span, idle, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getMapState("samples", "bucket long", "us array<long>, ids array<long>", self.ttl)
        self.frames = handle.getMapState("frames", "us long", "rows long", self.ttl)
        self.clock = handle.getValueState("clock", "newest long, last long, held long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, last, held = self.clock.get() if self.clock.exists() else (None, None, 0)
        added, frames, out = {}, set(), []
        for part in rows:
            for us, frame, i in zip(part["us"], part["frame"], part["event_id"], strict=True):
                if pd.isna(us):
                    continue
                us = int(us)
                newest = us if newest is None else max(newest, us)
                if last is not None and us <= last:
                    out.append((key[0], us, None, [] if frame else [int(i)], True))
                elif frame:
                    frames.add(us)
                else:
                    added.setdefault(us // self.span, []).append((us, int(i)))
        for us in frames:
            self.frames.updateValue((us,), (1,))
        for bucket, new in added.items():
            self._put(bucket, self._get(bucket) + new)
            held += len(new)
        if newest is not None:
            closed, last, held = self._close(key, newest - self.delay, last, held)
            out += closed
            held = self._evict(held)
            self.clock.update((newest, last, held))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.frames.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._table(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A sequence has been silent: what waits is put out as it is."""
        newest, last, held = self.clock.get() if self.clock.exists() else (None, None, 0)
        out = []
        if newest is not None:
            out, last, held = self._close(key, newest + 1, last, held)
            self.clock.update((newest, last, held))
        yield self._table(out)

    def _get(self, bucket: int) -> list[tuple[int, int]]:
        if not self.samples.containsKey((bucket,)):
            return []
        us, ids = self.samples.getValue((bucket,))
        return list(zip(map(int, us), map(int, ids), strict=True))

    def _put(self, bucket: int, rows: list[tuple[int, int]]) -> None:
        if rows:
            us, ids = zip(*rows, strict=True)
            self.samples.updateValue((bucket,), (list(us), list(ids)))
        else:
            self.samples.removeKey((bucket,))

    def _close(self, key: tuple, passed: int, last: int | None, held: int) -> tuple[list, int | None, int]:
        """Puts out the frames before `passed` and lets go of samples up to the last of them."""
        due = sorted(us for (us,) in list(self.frames.keys()) if us < passed)
        if not due:
            return [], last, held
        buckets, waiting, out = deque(sorted(b for (b,) in list(self.samples.keys()) if b <= due[-1] // self.span)), deque(), []
        for at in due:
            found = []
            while True:
                if not waiting:
                    if not buckets or buckets[0] > at // self.span:
                        break
                    bucket = buckets.popleft()
                    waiting.extend(sorted(self._get(bucket)))
                    self.samples.removeKey((bucket,))
                if waiting[0][0] > at:
                    break
                found.append(waiting.popleft())
            held -= len(found)
            out.append((key[0], at, last, [i for _, i in found] if last is not None else [], False))
            self.frames.removeKey((at,))
            last = at
        if waiting:
            self._put(waiting[0][0] // self.span, list(waiting))
        return out, last, held

    def _evict(self, held: int) -> int:
        """Lets the oldest samples go where more are held than may be."""
        if self.most is None or held <= self.most:
            return held
        for bucket in sorted(b for (b,) in list(self.samples.keys())):
            rows = sorted(self._get(bucket))
            self._put(bucket, rows[held - self.most :])
            held -= min(len(rows), held - self.most)
            if held <= self.most:
                break
        return held

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=COLUMNS).astype({"seq_id": "Int64", "us": "Int64", "start_us": "Int64", "late": "boolean"})


def stream_intervals_by_clock(rows: DataFrame, delay: int = 1_000_000, span: int = 1_000_000, idle: int | None = None, most: int | None = None, ttl: int | None = None) -> DataFrame:
    """Frames with the ids of their samples from a stream (seq_id, us, frame BOOLEAN, event_id).

    A sequence's clock is its newest time less `delay` microseconds: a frame is put out once the clock has passed
    it, with the samples after the frame before it, by time and id. Sequences don't wait for each other, and none makes
    another one's rows late, unlike under a watermark over all. With `idle`, a sequence that is silent for so many
    milliseconds puts out what waits; else its last frames wait for a later row. Rows at or before the last frame that was put out come back with `late` set (a sample's id in
    `samples`), so they can be counted; all others are in exactly one interval or still held.

    State is samples and frames after the last frame put out, in buckets of `span` microseconds; with `most`, the
    oldest samples beyond so many are let go at the end of a batch; with `ttl`, states untouched for so many
    milliseconds go. With `idle` or `ttl` Spark runs batches without rows for the sake of time, so a query with
    availableNow would not end: give it a trigger by time. Rows of a null time are left out, equal frame times are one frame, and samples before a
    sequence's first frame belong to none.
    """
    if span < 1 or delay < 0 or any(x is not None and x < 1 for x in (idle, most, ttl)):
        raise ValueError("span, idle, most and ttl must be positive, delay not negative")
    if rows.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError("the state is kept in RocksDB: call use_rocksdb first")
    mode = "None" if idle is None and ttl is None else "ProcessingTime"
    columns = rows.where("seq_id is not null").select("seq_id", "us", "frame", "event_id")
    return columns.groupBy("seq_id").transformWithStateInPandas(Intervals(delay, span, idle, most, ttl), SCHEMA, "append", mode)


def late_counts(out: DataFrame) -> DataFrame:
    """seq_id, late: rows that came too late, from a table of what the join has put out."""
    return out.groupBy("seq_id").agg({"late": "count_if"}).withColumnRenamed("count_if(late)", "late")
