import json

import pytest
from pyspark.sql import functions as F

from wayline.operators import folds, joins
from wayline.sources import files, sequence
from wayline.streaming import processors


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_camera_and_imu(spark, tmp_path):
    root = tmp_path / "flight"
    cam = put(root / "mav0/cam0/data.csv", "#timestamp [ns],filename\n30,c.png\n10, a.png ,x\n\n20,b.png\n")
    got = sequence.read_camera(spark, cam).orderBy("ts_ns").collect()
    assert [(r.seq_id, r.ts_ns, r.filename) for r in got] == [("flight", 10, "a.png"), ("flight", 20, "b.png"), ("flight", 30, "c.png")]
    imu = put(root / "mav0/imu0/data.csv", "2000000000,0.1,0.2,0.3,1,2,3\n1000000000,-0.1,-0.2,-0.3,-1,-2,-3\n")
    first = next(iter(sequence.replay(sequence.read_imu(spark, imu))))
    assert (first.ts, first.wx, first.az) == (1.0, -0.1, -3.0)
    for bad in ("1,2,3,4,5,6", "1,a,2,3,4,5,6", "1,nan,2,3,4,5,6", "-1,1,2,3,4,5,6"):
        path = put(tmp_path / f"bad{abs(hash(bad))}/imu0/data.csv", bad)
        with pytest.raises(Exception, match="line 1"):
            sequence.read_imu(spark, path).collect()
    assert [r.seq_id for r in sequence.discover(spark, str(tmp_path)).where("seq_id = 'flight'").collect()] == ["flight"]


def test_truth(spark, tmp_path):
    ok = put(tmp_path / "a/state_groundtruth_estimate0/data.csv", "1,0,0,0,-2,0,0,0,1,1,1\n1,0,0,0,1,0,0,0,1,1,1,5,6,7,8,9,10\n")
    rows = sequence.read_truth(spark, ok).orderBy("line").collect()
    assert rows[0].qw == 1.0 and rows[0].wx == 0.0 and rows[1].az == 10.0
    for i, bad in enumerate(("1,0,0,0,1,0,0,0,1,1", "1,0,0,0,0,0,0,0,1,1,1", "2,0,0,0,1,0,0,0,1,1,1\n1,0,0,0,1,0,0,0,1,1,1")):
        path = put(tmp_path / f"b{i}/state_groundtruth_estimate0/data.csv", bad)
        with pytest.raises(Exception, match="line"):
            sequence.read_truth(spark, path).collect()


def test_calibration(spark, tmp_path):
    yaml = "%YAML:1.0\nT_BS:\n  cols: 4\n  rows: 4\n  data: [0,-1,0,-0.02, 1,0,0,-0.06, 0,0,1,0.01, 0,0,0,1]\nintrinsics: [458,457,367,248]\nresolution: [752,480]\nrate_hz: 20\n"
    r = sequence.read_calibration(spark, put(tmp_path / "s/cam0/sensor.yaml", yaml)).first()
    assert r.seq_id == "s" and r.transform[3] == -0.02 and r.resolution == [752, 480] and r.rate_hz == 20.0
    assert sequence.read_calibration(spark, put(tmp_path / "t/cam0/sensor.yaml", "rate_hz: 5\n")).count() == 0
    with pytest.raises(Exception, match="calibration"):
        sequence.read_calibration(spark, put(tmp_path / "u/cam0/sensor.yaml", yaml.replace("0,-1,0,-0.02", "0,-2,0,-0.02"))).collect()


def test_point_clouds(spark, tmp_path):
    marks = spark.createDataFrame([(1, 0.5, 2.125, -3.75, 17, 34, 68), (2, 0.0, 1.0, 2.0, None, None, None)], "id long, x double, y double, z double, r int, g int, b int")
    text = [r.value for r in files.ply_lines(marks).collect()]
    assert "0.5000 2.1250 -3.7500 17 34 68" in text and text[-1].endswith("180 180 180") and "element vertex 2" in text
    files.write_ply(marks, f"{tmp_path}/cloud")
    assert [(r.x, r.r) for r in files.read_ply(spark, f"{tmp_path}/cloud").orderBy("line").collect()] == [(0.5, 17), (0.0, 180)]
    odd = put(tmp_path / "odd.ply", "ply\nend_header\n1 2 3\nbad row\n4 5 6 7 8 9\n")
    assert [(r.x, r.b) for r in files.read_ply(spark, odd).orderBy("line").collect()] == [(1.0, 120), (4.0, 9)]


def test_reports(spark):
    row = spark.sql("select named_struct('rmse_m', 1.5D, 'max_m', 2D) as ate, cast(null as double) as velocity")
    assert json.loads(files.metrics_json(row)) == {"ate": {"rmse_m": 1.5, "max_m": 2.0}}
    with pytest.raises(ValueError):
        files.metrics_json(row.limit(0))
    pair = spark.sql("select 7L seq_id, 2500000L us, 1D px, 2D py, 3D pz, 1D tx, 2D ty, 5D tz, 1D qw, 0D qx, 0D qy, 0D qz, 0D tw, 1D ti, 0D tj, 0D tk")
    got = files.error_rows(pair).first().asDict()
    assert list(got)[1] == "timestamp" and len(got) == 13 and got["timestamp"] == "2.500000" and got["error_z"] == "-2.000000"
    assert (got["position_error"], got["orientation_error_deg"]) == ("2.000000", "180.0000")


def test_streamed_intervals_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    rows = spark.read.parquet(path)
    rows.orderBy("ts").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/ev")
    stream = processors.event_stream(spark, f"{tmp_path}/ev", 10)
    got = processors.run_to_table(processors.stream_intervals(stream), "streamed", f"{tmp_path}/cp")
    ev = rows.select(F.col("user_id").alias("seq_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")
    batch = joins.interval_join(ev.where("event_type = 'view'"), ev.where("event_type <> 'view'"), ["event_id"])
    want = {(r.seq_id, r.us): (r.start_us, [s.event_id for s in r.samples]) for r in batch.collect()}
    streamed = {(r.seq_id, r.us): (r.start_us, list(r.samples)) for r in got.collect()}
    assert len(streamed) >= 0.9 * len(want) and all(want[k] == v for k, v in streamed.items())


def test_streamed_health_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(path).coalesce(1).write.parquet(f"{tmp_path}/ev")
    cols = lambda d: d.select("seq_id", "us", (F.col("event_type") != "error").alias("visual"), F.when(F.col("k") < 15, 5).otherwise(30).alias("features"), (F.col("value") < 400).alias("valid"), (F.col("event_type") != "signup").alias("ready"))
    got = processors.run_to_table(processors.stream_health(cols(processors.event_stream(spark, f"{tmp_path}/ev")), 10, 3), "health", f"{tmp_path}/cp")
    rows = spark.read.parquet(path).select(F.col("user_id").alias("seq_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    want = folds.health_states(cols(rows), 10, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
