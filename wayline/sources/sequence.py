"""Recorded sequences: camera index, inertial samples, ground truth and calibration, one folder each.

Readers take a path or a glob of many sequences; seq_id is the folder above `mav0` (or above the sensor's
folder).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import finite
from ..operators.prefix import Scan, nearest, running_count, scan

SENSORS = {"cam": "cam0/data.csv", "imu": "imu0/data.csv", "truth": "state_groundtruth_estimate0/data.csv"}
TRUTH = ["px", "py", "pz", "qw", "qx", "qy", "qz", "vx", "vy", "vz", "wx", "wy", "wz", "ax", "ay", "az"]
IMU = ["wx", "wy", "wz", "ax", "ay", "az"]


def sensor_path(root: str, sensor: str, nested: bool = True) -> str:
    return f"{root}/{'mav0/' if nested else ''}{SENSORS[sensor]}"


def placed_lines(spark: SparkSession, path: str, **carried: Scan) -> DataFrame:
    """_file, text, line (place in the file, from 0) and the scans `carried` along each file's lines.

    Files are split by ranges of bytes among tasks; a split's start and a line's place within it make the
    order. How many lines come before a split, and what is carried over its start, comes from a table of one
    row for each split, so a file of any size is read by many tasks.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_span"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text"))
    rows = scan(rows, None, ["_row"], seq="_file", line=running_count(), **carried)
    return rows.withColumn("line", F.col("line") - 1).drop("_span", "_row")


def is_data() -> Column:
    return (F.trim("text") != "") & ~F.trim("text").startswith("#")


def lines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """seq_id, line, fields: lines without blanks and comments, split at commas.

    Files are split among tasks, and line is a number that grows along each split. With ordered, line is the
    place in the file, and before_ns is the time that the data line before has, whatever split it is in.
    """
    if ordered:
        time = F.trim(F.split("text", ",")[0]).try_cast("long")
        rows = placed_lines(spark, path, before_ns=nearest(F.struct(time.alias("ns")), is_data(), strict=True))
        rows = rows.withColumn("before_ns", F.col("before_ns.ns"))
    else:
        rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    seq = F.regexp_extract("_file", r"([^/]+)/(?:mav0/)?[^/]+/[^/]+$", 1)
    fields = F.transform(F.split("text", ","), lambda f: F.trim(f))
    return rows.where(is_data()).select(seq.alias("seq_id"), "line", fields.alias("fields"), *(["before_ns"] if ordered else []))


def fail(message: str) -> Column:
    return F.raise_error(F.concat(F.lit(message + " in line "), F.col("line") + 1, F.lit(" of "), F.col("seq_id")))


def time_ns() -> Column:
    ns = F.try_element_at("fields", F.lit(1)).try_cast("long")
    return F.when(ns >= 0, ns).otherwise(fail("no valid time").cast("long"))


def number(i: int, default: float | None = None) -> Column:
    raw = F.try_element_at("fields", F.lit(i + 1))
    x = raw.try_cast("double")
    checked = F.when(finite(x), x).otherwise(fail("no finite number").cast("double"))
    return checked if default is None else F.when(raw.isNull(), default).otherwise(checked)


def seconds(ns: str = "ts_ns") -> Column:
    return (F.col(ns) * 1e-9).alias("ts")


def read_camera(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, ts_ns, ts, filename; two fields at least, further ones aren't read. Order is by time, then line."""
    ok = (F.size("fields") >= 2) & (F.col("fields")[1] != "")
    rows = lines(spark, path).select("seq_id", "line", time_ns().alias("ts_ns"), F.when(ok, F.col("fields")[1]).otherwise(fail("no file name").cast("string")).alias("filename"))
    return rows.select("seq_id", "ts_ns", seconds(), "filename", "line")


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, ts_ns, ts, angular rates wx.., specific forces ax..; seven finite fields, rates first."""
    ok = F.size("fields") == 7
    rows = lines(spark, path).withColumn("fields", F.when(ok, F.col("fields")).otherwise(fail("not seven fields").cast("array<string>")))
    return rows.select("seq_id", "line", time_ns().alias("ts_ns"), *(number(i + 1).alias(c) for i, c in enumerate(IMU))).select("seq_id", "ts_ns", seconds(), *IMU, "line")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, ts_ns, ts and TRUTH; 11 to 17 fields, the missing tail is 0. Times mustn't decrease in file
    order; quaternions are normalized and turned to w >= 0."""
    ok = F.size("fields").between(11, 17)
    rows = lines(spark, path, ordered=True).withColumn("fields", F.when(ok, F.col("fields")).otherwise(fail("not 11 to 17 fields").cast("array<string>")))
    rows = rows.select("seq_id", "line", time_ns().alias("ts_ns"), *(number(i + 1, 0.0 if i >= 10 else None).alias(c) for i, c in enumerate(TRUTH)), "before_ns")
    rows = rows.withColumn("ts_ns", F.when(F.col("before_ns") > F.col("ts_ns"), fail("time decreases").cast("long")).otherwise(F.col("ts_ns")))
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in ("qx", "qy", "qz")), F.col("qw") * F.col("qw")))
    unit = F.when(n < 1e-6, fail("quaternion near zero").cast("double")).otherwise(n) * F.when(F.col("qw") < 0, -1.0).otherwise(1.0)
    rows = rows.withColumn("unit", unit)
    return rows.select("seq_id", "ts_ns", seconds(), *((F.col(c) / F.col("unit")).alias(c) if c[0] == "q" else F.col(c) for c in TRUTH), "line")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row per sensor.yaml: seq_id, transform (16, by rows), intrinsics, distortion, resolution, rate_hz.

    Files without T_BS give no row; one that can't be read, or whose transform isn't rigid, is an error.
    """
    import pandas as pd

    kinds = "seq_id string, transform array<double>, intrinsics array<double>, distortion array<double>, resolution array<int>, rate_hz double"
    seq = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:mav0/)?[^/]+/[^/]+$", 1)

    def parse(frames):
        import yaml

        for t in frames:
            out = []
            for name, text in zip(t["seq_id"], t["value"], strict=True):
                try:
                    spec = yaml.safe_load("\n".join(x for x in text.splitlines() if not x.startswith("%"))) or {}
                    if "T_BS" not in spec:
                        continue
                    m = [float(x) for x in spec["T_BS"]["data"]]
                    check_transform(m)
                    floats = lambda k: [float(x) for x in spec.get(k) or []]  # noqa: B023, E731
                    rate = spec.get("rate_hz")
                    out.append((name, m, floats("intrinsics"), floats("distortion_coefficients"), [int(x) for x in spec.get("resolution") or []], None if rate is None else float(rate)))
                except Exception as e:
                    raise ValueError(f"calibration of {name}: {e}") from e
            yield pd.DataFrame(out, columns=[f.split()[0] for f in kinds.split(", ")])

    return spark.read.text(path, wholetext=True).select(seq.alias("seq_id"), "value").mapInPandas(parse, kinds)


def check_transform(m: list[float], tolerance: float = 1e-3) -> None:
    """Raises unless 16 values by rows are a rigid transform."""
    if len(m) != 16 or not all(map(math.isfinite, m)):
        raise ValueError("not 16 finite values")
    r = [m[0:3], m[4:7], m[8:11]]
    for i in range(3):
        for j in range(3):
            if abs(sum(a * b for a, b in zip(r[i], r[j], strict=True)) - (i == j)) > tolerance:
                raise ValueError("the rotation isn't orthonormal")
    det = sum(r[0][i] * (r[1][(i + 1) % 3] * r[2][(i + 2) % 3] - r[1][(i + 2) % 3] * r[2][(i + 1) % 3]) for i in range(3))
    if abs(det - 1) > tolerance or any(abs(a - b) > tolerance for a, b in zip(m[12:], (0, 0, 0, 1), strict=True)):
        raise ValueError("not a rigid transform")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """seq_id, path of the sequences below a folder of Hadoop's file systems, hidden ones left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    found = [s for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    rows = sorted((s.getPath().getName(), s.getPath().toString()) for s in found if not s.getPath().getName().startswith("."))
    return spark.createDataFrame(rows, "seq_id string, path string")


def replay(rows: DataFrame, ts: str = "ts_ns"):
    """Rows in time order, one after another, as a live sensor would give them."""
    return rows.orderBy(ts, "line").toLocalIterator(prefetchPartitions=True)
