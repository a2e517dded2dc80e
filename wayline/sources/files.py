"""Point clouds, error tables, metrics and weights as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.prefix import HOUR, running_count, scan
from .sequence import placed_lines


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """line, x, y, z, r, g, b of ASCII point clouds, read in splits; malformed rows are skipped, a missing colour is 120."""
    header = running_count(F.when(F.trim("text") == "end_header", 1))
    rows = placed_lines(spark, path, ends=header).where("ends > 0").withColumn("f", F.split(F.trim("text"), r"\s+"))
    at = lambda i, kind: F.try_element_at("f", F.lit(i)).try_cast(kind)
    rows = rows.select("line", *(at(i + 1, "double").alias(c) for i, c in enumerate("xyz")), *(F.coalesce(at(i + 4, "int"), F.lit(120)).alias(c) for i, c in enumerate("rgb")))
    return rows.where("x is not null and y is not null and z is not null")


def ply_lines(landmarks: DataFrame) -> DataFrame:
    """Text lines of a point cloud in id order: coordinates of four digits, and colours if any row has one;
    rows without are then 180 gray."""
    coloured = landmarks.agg(F.max(F.col("r").isNotNull()).alias("coloured"), F.count("*").alias("n")).first()
    point = F.format_string("%.4f %.4f %.4f", "x", "y", "z")
    if coloured.coloured:
        point = F.concat(point, F.lit(" "), F.format_string("%d %d %d", *(F.coalesce(c, F.lit(180)).cast("int") for c in "rgb")))
    head = ["ply", "format ascii 1.0", f"element vertex {coloured.n}", *(f"property float {c}" for c in "xyz")]
    head += [f"property uchar {c}" for c in ("red", "green", "blue")] if coloured.coloured else []
    header = landmarks.sparkSession.createDataFrame([(-len(head) - 1 + i, t) for i, t in enumerate([*head, "end_header"])], "id long, value string")
    return header.union(landmarks.select(F.col("id").cast("long"), point)).orderBy("id").select("value")


def write_ply(landmarks: DataFrame, path: str) -> None:
    """One file in the folder `path`: the format has a single header, so its rows go through one writer."""
    ply_lines(landmarks).coalesce(1).write.text(path)


def error_rows(pairs: DataFrame) -> DataFrame:
    """Per-frame errors as fixed decimals, ready for a CSV sink: times in seconds, both positions, their
    difference by axis and as a whole, and the angle between the orientations."""
    six = lambda c: F.format_string("%.6f", c)
    cols = {"timestamp": six(F.col("us") * 1e-6)}
    cols |= {f"estimated_{a}": six(F.col(f"p{a}")) for a in "xyz"} | {f"groundtruth_{a}": six(F.col(f"t{a}")) for a in "xyz"}
    gap = g.sub(g.vec("px", "py", "pz"), g.vec("tx", "ty", "tz"))
    cols |= {f"error_{a}": six(d) for a, d in zip("xyz", gap, strict=True)} | {"position_error": six(g.norm(gap))}
    cols["orientation_error_deg"] = F.format_string("%.4f", g.q_angle(g.vec("qw", "qx", "qy", "qz"), g.vec("tw", "ti", "tj", "tk")))
    return pairs.orderBy("seq_id", "us").select("seq_id", *(v.alias(k) for k, v in cols.items()))


def write_errors(pairs: DataFrame, path: str) -> None:
    error_rows(pairs).write.csv(path, header=True)


def metrics_json(row: DataFrame) -> str:
    """Nested metrics of a one-row table as JSON; absent sections are left out. No row is an error."""
    found = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("j")).limit(1).collect()
    if not found:
        raise ValueError("nothing was evaluated")
    return json.dumps(json.loads(found[0].j), indent=2)


def weights_json(weights: dict) -> str:
    return json.dumps({k: v.tolist() for k, v in weights.items()})


def read_weights(text: str) -> dict:
    import numpy as np

    return {k: np.array(v, float) for k, v in json.loads(text).items()}


def messages(states: DataFrame) -> DataFrame:
    """Navigation messages (seq_id, us, value): JSON of position, velocity, orientation, status and flags."""
    from ..functions.geometry import finite

    fields = ["px", "py", "pz", "vx", "vy", "vz", "qw", "qx", "qy", "qz"]
    valid = finite(*(F.col(c) for c in fields))
    body = F.struct((F.col("us") * 1e-6).alias("timestamp_s"), F.array("px", "py", "pz").alias("position_m"), F.array("vx", "vy", "vz").alias("velocity_mps"), F.array("qw", "qx", "qy", "qz").alias("orientation"), "status", F.create_map(F.lit("numerically_valid"), valid).alias("health_flags"))
    return states.select("seq_id", "us", F.to_json(body).alias("value"))


def every(rows: DataFrame, n: int, span: int = HOUR) -> DataFrame:
    """Each n-th row of a sequence by time, for a sampled console."""
    return scan(rows, span, _r=running_count()).where(F.col("_r") % n == 0).drop("_r")
