"""Files in many splits, and sequences as a data source, in batch and replayed."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.sources import files, replay, sequence


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def truth_file(folder, times, end="\n"):
    at = folder / "state_groundtruth_estimate0"
    at.mkdir(parents=True)
    rows = [f"{t},{i},0,0,1,0,0,0,0,0,0" for i, t in enumerate(times)]
    (at / "data.csv").write_text(end.join(["#timestamp", "", *rows]) + end)
    return str(at / "data.csv")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_order_over_split_ends(spark, tmp_path, tiny_splits, end):
    path = truth_file(tmp_path / "one", [100 + i // 2 for i in range(120)], end)
    df = sequence.read_truth(spark, path)
    rows = df.collect()
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    assert sorted((r.line, int(r.px)) for r in rows) == [(i + 2, i) for i in range(120)] and {r.seq_id for r in rows} == {"one"}


@pytest.mark.parametrize("at", [1, 9, 17, 60, 118, 119])
def test_decreasing_times_are_found_in_any_split(spark, tmp_path, tiny_splits, at):
    times = list(range(1000, 1120))
    times[at] = times[at - 1] - 1
    with pytest.raises(Exception, match=f"time decreases in line {at + 3} of two"):
        sequence.read_truth(spark, truth_file(tmp_path / "two", times)).collect()


def test_point_clouds_in_splits(spark, tmp_path, tiny_splits):
    for name, n in (("a", 100), ("b", 3)):
        head = ["ply", "format ascii 1.0", f"element vertex {n}", "1 2 3", "end_header"]
        (tmp_path / f"{name}.ply").write_text("\n".join([*head, *(f"{i} {i}.5 -1 {i} 0 0" for i in range(n)), "end_header", "junk"]) + "\n")
    rows = files.read_ply(spark, str(tmp_path)).collect()
    assert sorted((r.line, r.x, r.y, r.r) for r in rows) == sorted((i + 5, float(i), i + 0.5, i) for n in (100, 3) for i in range(n))


def recorded(root, n=300, seed=0):
    """Two sequences, one in the layout with mav0, with lines out of order, comments and blanks."""
    r = random.Random(seed)
    for name, inner in (("first", "mav0/"), ("second", "")):
        for sensor in ("imu", "cam"):
            path = root / name / (inner + sequence.SENSORS[sensor])
            path.parent.mkdir(parents=True)
            times = sorted(r.sample(range(10**9, 4 * 10**9), n))
            times[5], times[6] = times[6], times[5]
            value = (lambda: "a b.png") if sensor == "cam" else (lambda: ",".join(f"{r.gauss(0, 1):.4f}" for _ in range(6)))
            lines = ["#timestamp", *(f"{t},{value()}" for t in times)]
            lines.insert(20, "")
            path.write_text("\n".join(lines) + ("\n" if sensor == "imu" else ""))


@pytest.mark.parametrize("size", [50, 777, 10**6])
def test_data_source_equals_the_readers(spark, tmp_path, size):
    recorded(tmp_path)
    replay.register(spark)
    read = lambda sensor: spark.read.format(replay.NAME).option("sensor", sensor).option("rangeBytes", size).load(str(tmp_path))
    imu = sequence.read_imu(spark, f"{tmp_path}/*/imu0/data.csv").unionByName(sequence.read_imu(spark, f"{tmp_path}/*/mav0/imu0/data.csv")).select("seq_id", "ts_ns", *sequence.IMU)
    assert sorted(map(tuple, read("imu").collect())) == sorted(map(tuple, imu.collect())) and read("imu").count() == 600
    cam = sequence.read_camera(spark, f"{tmp_path}/*/cam0/data.csv").unionByName(sequence.read_camera(spark, f"{tmp_path}/*/mav0/cam0/data.csv")).select("seq_id", "ts_ns", "filename")
    assert sorted(map(tuple, read("cam").collect())) == sorted(map(tuple, cam.collect()))


def test_data_source_of_nothing_and_of_bad_lines(spark, tmp_path):
    replay.register(spark)
    assert spark.read.format(replay.NAME).load(str(tmp_path)).collect() == []
    recorded(tmp_path)
    with pytest.raises(Exception, match="sensor must be"):
        spark.read.format(replay.NAME).option("sensor", "radar").load(str(tmp_path)).collect()
    with (tmp_path / "second/imu0/data.csv").open("a") as f:
        f.write("5000000000,1,2,3,4,5,nan\n")
    with pytest.raises(Exception, match="no valid line of imu in second"):
        spark.read.format(replay.NAME).load(str(tmp_path)).collect()


def test_replay_restarts_from_its_checkpoint(spark, tmp_path):
    recorded(tmp_path / "in", 120)
    replay.register(spark)

    def run(batches):
        """Replays some batches and stops: as a process that ends would, without a last word."""
        df = spark.readStream.format(replay.NAME).option("rangeBytes", 900).option("stepMs", 400).option("checkpoint", f"{tmp_path}/check").load(str(tmp_path / "in"))
        q = df.writeStream.foreachBatch(lambda t, i: t.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{tmp_path}/out/{i:03d}")).option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            for _ in range(600):
                if q.exception() is not None:
                    raise q.exception()
                if q.lastProgress and q.lastProgress["batchId"] >= batches:
                    break
                q.awaitTermination(0.1)
        finally:
            q.stop()

    run(2)
    first = spark.read.parquet(f"{tmp_path}/out/*").count()
    assert 0 < first < 240
    run(8)
    out = spark.read.parquet(f"{tmp_path}/out/*")
    want = spark.read.format(replay.NAME).load(str(tmp_path / "in"))
    assert sorted(map(tuple, out.drop("batch").collect())) == sorted(map(tuple, want.collect()))
    spans = sorted((r.batch, r.lo, r.hi) for r in out.groupBy("batch").agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).collect())
    assert len(spans) >= 7 and all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))  # by time


def test_offsets_after_restarts(tmp_path):
    recorded(tmp_path / "in", 50)
    made = lambda check: replay.SequenceStream(str(tmp_path / "in"), "imu", 500, 400, str(tmp_path / check))
    stream = made("none")
    first = stream.initialOffset()["ns"]
    steps = [stream.latestOffset()["ns"] for _ in range(20)]
    assert steps[:3] == [first + k * 400_000_000 for k in (1, 2, 3)] and steps[-1] == steps[-2]
    (tmp_path / "check/offsets").mkdir(parents=True)
    for i, ns in ((9, first + 3), (10, first + 7)):
        (tmp_path / f"check/offsets/{i}").write_text('v1\n{"batchWatermarkMs":0}\n{"ns": %d}' % ns)
    after = made("check")
    assert after.latestOffset()["ns"] == first + 7 + 400_000_000
    lines = [r for p in after.partitions({"ns": first + 7}, {"ns": steps[-1]}) for b in after.read(p) for r in b.to_pylist()]
    everything = [r for p in stream.partitions({"ns": first}, {"ns": steps[-1]}) for b in stream.read(p) for r in b.to_pylist()]
    assert len(everything) == 100 and sorted(r["ts_ns"] for r in lines) == sorted(r["ts_ns"] for r in everything if r["ts_ns"] >= first + 7)
    assert replay.SequenceStream(str(tmp_path / "in"), "imu", 500).latestOffset()["ns"] == steps[-1]
    with pytest.raises(ValueError, match="checkpoint"):
        replay.SequenceStream(str(tmp_path), "imu", 500, 400)
