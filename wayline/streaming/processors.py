"""Structured Streaming forms of the interval join and the health machine.

State is kept per sequence and bounded by the watermark: samples up to the last frame that has been put
out are let go. Rows later than the watermark are dropped by Spark before they come here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import INITIALIZING, health_step

SYNCED = "seq_id long, us long, start_us long, samples array<long>"


def stream_intervals(rows: DataFrame, delay: str = "1 second") -> DataFrame:
    """Frames with the ids of their samples from rows (seq_id, ts TIMESTAMP, us, frame BOOLEAN, event_id).

    A frame is put out once the watermark has passed it, as no earlier row can come any more.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, frames, samples = state.get if state.exists else (None, [], [])
        frames, samples = list(frames), [tuple(x) for x in samples]
        for t in parts:
            for us, frame, event_id in zip(t["us"], t["frame"], t["event_id"], strict=True):
                if frame:
                    frames.append(int(us))
                else:
                    samples.append((int(us), int(event_id)))
        passed = state.getCurrentWatermarkMs() * 1000
        frames, out = sorted(set(frames)), []
        samples.sort()
        while frames and frames[0] < passed:
            at = frames.pop(0)
            found = [e for us, e in samples if last is not None and last < us <= at]
            out.append((key[0], at, last, found))
            last, samples = at, [x for x in samples if x[0] > at]
        state.update((last, frames, samples))
        if frames:
            state.setTimeoutTimestamp(max(frames[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["seq_id", "us", "start_us", "samples"]).astype({"start_us": "Int64"})

    kept = "last long, frames array<long>, samples array<struct<us: long, id: long>>"
    marked = rows.withWatermark("ts", delay).select("seq_id", "ts", "us", "frame", "event_id")
    return marked.groupBy("seq_id").applyInPandasWithState(step, SYNCED, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_health(rows: DataFrame, least: int = 10, timeout: int = 50) -> DataFrame:
    """seq_id, us, state, count for rows (seq_id, us, valid, ready, visual, features), in time order within
    each micro-batch; a batch mustn't hold rows earlier than the one before."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, count = state.get if state.exists else (INITIALIZING, 0)
        for t in [pd.concat(list(parts)).sort_values("us")]:
            out = []
            for r in t.itertuples():
                name, count = health_step(name, count, r.valid, r.ready, r.visual, r.features, least, timeout)
                out.append((key[0], r.us, name, count))
            yield pd.DataFrame(out, columns=["seq_id", "us", "state", "count"])
        state.update((name, count))

    columns = rows.select("seq_id", "us", "valid", "ready", "visual", "features")
    return columns.groupBy("seq_id").applyInPandasWithState(step, "seq_id long, us long, state string, count long", "state string, count long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a streaming table over what is available and gives the result as a table in memory."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(600)
    return df.sparkSession.table(name)


def event_stream(spark, path: str, batches: int = 1) -> DataFrame:
    """A file stream of an events table: seq_id, ts, us, frame, event_id."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", batches).parquet(path)
    ts = F.col("ts").cast("timestamp")
    return rows.select(F.col("user_id").alias("seq_id"), ts.alias("ts"), F.unix_micros(ts).alias("us"), (F.col("event_type") == "view").alias("frame"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
