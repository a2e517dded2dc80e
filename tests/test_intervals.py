"""The streamed interval join by sequence clocks, against the batch join and planted late rows."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.operators import joins
from wayline.streaming import intervals

SCHEMA = "seq_id long, us long, frame boolean, event_id long"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get(intervals.PROVIDER)
    intervals.use_rocksdb(spark)
    yield
    spark.conf.set(intervals.PROVIDER, before)


def put(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:04}.parquet"
    pd.DataFrame(rows, columns=["seq_id", "us", "frame", "event_id"]).astype({"seq_id": "int64", "us": "Int64", "event_id": "int64"}).to_parquet(path)
    os.utime(path, (1_600_000_000 + number, 1_600_000_000 + number))


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = intervals.stream_intervals_by_clock(stream, **options)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert q.awaitTermination(200)
    return spark.read.schema(intervals.SCHEMA).parquet(f"{tmp_path}/out")


def plain(table):
    rows = ((r.seq_id, r.us, r.start_us, list(r.samples), r.late) for r in table.collect())
    return sorted(rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3]))


def test_equals_batch_over_a_restart(spark, tmp_path):
    """Rows come in five batches, out of order within the delay; the query is stopped and started between them."""
    path, delay = "/root/testdata/sf0.001/events.parquet", 3_600_000_000
    ev = spark.read.parquet(path).where("user_id is not null").select(F.col("user_id").alias("seq_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "view").alias("frame"), "event_id")
    rows = ev.toPandas()
    rows = rows[rows["seq_id"].isin(sorted(rows["seq_id"].unique())[:12])]
    rows = rows.iloc[(rows["us"] + rows["event_id"] % 50 * (delay // 50)).argsort(kind="stable")]
    parts = [rows.iloc[i * len(rows) // 5 : (i + 1) * len(rows) // 5] for i in range(5)]
    for i in range(2):
        put(tmp_path / "in", i, parts[i])
    run(spark, tmp_path, delay=delay, span=86_400_000_000)
    for i in range(2, 5):
        put(tmp_path / "in", i, parts[i])
    got = plain(run(spark, tmp_path, delay=delay, span=86_400_000_000))
    given = spark.createDataFrame(rows)
    batch = joins.interval_join(given.where("frame"), given.where("not frame"), ["event_id"]).select("seq_id", "us", "start_us", F.col("samples.event_id").alias("samples"), F.lit(False).alias("late"))
    newest = rows.groupby("seq_id")["us"].max()
    want = [r for r in plain(batch) if r[1] < newest[r[0]] - delay]
    assert got == want and len(want) > 20


def test_late_rows_idle_sequences_and_limits(spark, tmp_path):
    """Late rows are told apart by their own sequence alone; more samples than may be held let the oldest go."""
    put(tmp_path / "in", 0, [(1, 10, True, 1), (1, 12, False, 2), (1, 20, True, 3), (1, 25, False, 4), (1, 30, False, 5), (2, 5, True, 6)])
    put(tmp_path / "in", 1, [(1, 15, False, 7), (1, 20, True, 8), (1, None, False, 9), (2, 6, False, 10), (2, 8, True, 11), (2, 9, False, 12)])
    put(tmp_path / "in", 2, [(1, 26, False, 13), (1, 40, True, 14), (1, 41, False, 15), (2, 7, False, 16)])
    out = run(spark, tmp_path, delay=0, span=4, most=2)
    assert plain(out) == [
        (1, 10, None, [], False),
        (1, 15, None, [7], True),
        (1, 20, None, [], True),
        (1, 20, 10, [2], False),
        (1, 40, 20, [4, 13, 5], False),
        (2, 5, None, [], False),
        (2, 7, None, [16], True),
        (2, 8, 5, [10], False),
    ]
    assert {r.seq_id: r.late for r in intervals.late_counts(out).collect()} == {1: 2, 2: 1}


def test_oldest_samples_go(spark, tmp_path):
    put(tmp_path / "in", 0, [(1, 10, True, 1), *((1, 11 + i, False, 10 + i) for i in range(6))])
    put(tmp_path / "in", 1, [(1, 30, True, 2), (1, 31, False, 20)])
    assert plain(run(spark, tmp_path, delay=0, span=2, most=3)) == [(1, 10, None, [], False), (1, 30, 10, [13, 14, 15], False)]


def test_a_silent_sequence_puts_out_what_waits(spark, tmp_path):
    put(tmp_path / "in", 0, [(1, 10, True, 1), (1, 12, False, 2), (1, 20, True, 3)])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    out = intervals.stream_intervals_by_clock(stream, delay=100, idle=500)
    q = out.writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 120
        while spark.table("silent").count() < 2 and time.time() < end:
            time.sleep(1)
    finally:
        q.stop()
    assert plain(spark.table("silent")) == [(1, 10, None, [], False), (1, 20, 10, [2], False)]


def test_arguments(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        intervals.stream_intervals_by_clock(rows, span=0)
    spark.conf.unset(intervals.PROVIDER)
    with pytest.raises(ValueError):
        intervals.stream_intervals_by_clock(rows)
