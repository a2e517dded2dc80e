"""Sparse mapping as relations: tracks, two-view triangulation, acceptance, landmark upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from .tables import saved


def with_first_observation(obs: DataFrame) -> DataFrame:
    """Later observations (track, kf, ...) joined to their track's first: first."""
    w = Window.partitionBy("track").orderBy("kf")
    return obs.withColumn("first", F.first(F.struct(*obs.columns)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kf > first.kf")


def triangulate(pairs: DataFrame, p0: str, p1: str, x0: str, x1: str) -> DataFrame:
    """Adds x, y, z by the direct linear transform from two 3x4 projections (arrays of 12) and normalized
    points (arrays of 2); null where the system is degenerate."""

    @F.pandas_udf("struct<x: double, y: double, z: double>")
    def solve(a: pd.Series, b: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
        n = len(a)
        if not n:
            return pd.DataFrame({"x": [], "y": [], "z": []})
        pa_, pb, ua, vb = (np.stack([np.asarray(x, float) for x in s]) for s in (a, b, u, v))
        pa_, pb = pa_.reshape(n, 3, 4), pb.reshape(n, 3, 4)
        rows = [ua[:, :1] * pa_[:, 2] - pa_[:, 0], ua[:, 1:] * pa_[:, 2] - pa_[:, 1], vb[:, :1] * pb[:, 2] - pb[:, 0], vb[:, 1:] * pb[:, 2] - pb[:, 1]]
        _, s, vt = np.linalg.svd(np.stack(rows, axis=1))
        h = vt[:, 3]
        ok = (s[:, 2] >= 1e-4) & (np.abs(h[:, 3]) >= 1e-12)
        out = h[:, :3] / np.where(ok, h[:, 3], 1.0)[:, None]
        out[~ok] = np.nan
        return pd.DataFrame(out, columns=["x", "y", "z"])

    return pairs.withColumn("_x", solve(p0, p1, x0, x1)).withColumns({c: F.col(f"_x.{c}") for c in "xyz"}).drop("_x")


def acceptance(parallax: Column, z0: Column, z1: Column, e0: Column, e1: Column, point: g.Vec, least_angle=1.0, near=0.1, far=50.0, most_error=2.0) -> Column:
    """Status of a triangulated landmark, the first rule that applies."""
    return (
        F.when(~g.finite(*point), "REJECTED_NUMERICAL")
        .when(parallax < least_angle, "REJECTED_PARALLAX")
        .when((z0 <= 0) | (z1 <= 0), "REJECTED_NEGATIVE_DEPTH")
        .when((F.least(z0, z1) < near) | (F.greatest(z0, z1) > far), "REJECTED_DEPTH_RANGE")
        .when(~g.finite(e0, e1), "REJECTED_NUMERICAL")
        .when((e0 > most_error) | (e1 > most_error), "REJECTED_REPROJECTION")
        .otherwise("SUCCESS")
    )


def first_success(attempts: DataFrame) -> DataFrame:
    """Per track the first accepted attempt (kf order): kf, and the attempts made up to it."""
    done = attempts.groupBy("track").agg(F.min(F.when(F.col("status") == "SUCCESS", F.col("kf"))).alias("done"))
    made = attempts.join(done, "track").where("done is null or kf <= done")
    return made.groupBy("track").agg(F.first("done").alias("kf"), F.count("*").alias("attempts"))


def build_map(obs: DataFrame, lens: dict[str, float], rounds: int = 8, **limits) -> DataFrame:
    """Landmarks from what key frames see of tracks: obs (track, kf, r: rotation of the camera in the world, 9
    values by rows, c: its centre, 3 values, u, v: pixel).

    Every later observation of a track is triangulated with its first; the first accepted one (`acceptance`,
    with its limits) ends the tries. One row per track seen more than once: track, kf (null: none accepted),
    attempts, and of the accepted one x, y, z, error (mean of both in pixels) and depth.
    """
    x, y = g.undistort(F.col("u"), F.col("v"), **lens, rounds=rounds)
    mat = lambda at: tuple(tuple(F.col(f"{at}r")[3 * i + j] for j in range(3)) for i in range(3))
    centre = lambda at: tuple(F.col(f"{at}c")[i] for i in range(3))
    back = g.m_transpose(mat(""))
    offset = g.scale(g.m_apply(back, centre("")), -1.0)
    camera = F.array(*(e for row, t in zip(back, offset, strict=True) for e in (*row, t)))
    seen = with_first_observation(obs.select("track", "kf", "r", "c", "u", "v", camera.alias("p"), F.array(x, y).alias("xy")))
    found = triangulate(seen, "first.p", "p", "first.xy", "xy")
    point = g.vec("x", "y", "z")
    inside = {n: g.body_to_camera(mat(at), centre(at), point) for n, at in (("0", "first."), ("1", ""))}
    found = found.withColumns({f"q{n}": F.array(*v) for n, v in inside.items()})
    pixel = lambda n: g.project(tuple(F.col(f"q{n}")[i] for i in range(3)), **lens)
    miss = lambda n, at: F.when(F.col(f"q{n}")[2] != 0, g.norm((*g.sub(pixel(n), (F.col(f"{at}u"), F.col(f"{at}v"))), F.lit(0.0))))
    found = found.withColumns({"angle": g.parallax(centre("first."), centre(""), point), "e0": miss("0", "first."), "e1": miss("1", "")})
    depth = F.col("q1")[2]
    status = acceptance(F.col("angle"), F.col("q0")[2], depth, F.col("e0"), F.col("e1"), point, **limits)
    tries = saved(found.select("track", "kf", status.alias("status"), "x", "y", "z", ((F.col("e0") + F.col("e1")) / 2).alias("error"), depth.alias("depth")))
    return first_success(tries).join(tries.where("status = 'SUCCESS'").drop("status"), ["track", "kf"], "left")


def landmark_upkeep(created: DataFrame, updates: DataFrame, most_error: float) -> DataFrame:
    """Landmarks (id, error, us) with later observations (id, error, z, us) of positive depth and small error:
    observations, mean error and last time. A new landmark counts as two observations."""
    ok = updates.where((F.col("z") > 0) & (F.col("error") <= most_error)).groupBy("id").agg(F.count("*").alias("m"), F.sum("error").alias("sum"), F.max("us").alias("last"))
    out = created.join(ok, "id", "left")
    n = 2 + F.coalesce("m", F.lit(0))
    return out.select("id", n.alias("observations"), ((2 * F.col("error") + F.coalesce("sum", F.lit(0.0))) / n).alias("mean_error"), F.greatest("us", "last").alias("last_us"))


def first_landmarks(landmarks: DataFrame, most: int) -> DataFrame:
    """The first `most` landmarks of each sequence by creation; the rest are refused."""
    return landmarks.withColumn("n", F.row_number().over(Window.partitionBy("seq_id").orderBy("us", "id"))).where(F.col("n") <= most)


def keyframe_pose(q: g.Vec, p: g.Vec, rotation: g.Mat, offset: g.Vec) -> tuple[g.Mat, g.Vec]:
    """Camera pose in the world from a body pose and the camera's place on the body."""
    body = g.q_matrix(q)
    return g.m_product(body, rotation), g.add(p, g.m_apply(body, offset))


def track_ids(linked: DataFrame) -> DataFrame:
    """track of every point (seq_id, frame, idx, prev_idx): points inherit the track of the point they are
    linked to in the frame before, others start one; tracks are numbered by their first point.

    Chains are halved by pointer jumping, so a track of n frames takes log n joins on its points.
    """
    at = linked.select("seq_id", "frame", "idx", F.when(F.col("prev_idx").isNotNull(), F.struct((F.col("frame") - 1).alias("frame"), F.col("prev_idx").alias("idx"))).alias("up"), F.struct("frame", "idx").alias("top"))
    at = saved(at)
    while not at.where("up is not null").isEmpty():
        above = at.select("seq_id", F.col("frame").alias("uf"), F.col("idx").alias("ui"), F.col("up").alias("next"), F.col("top").alias("best"))
        out = at.withColumns({"uf": F.col("up.frame"), "ui": F.col("up.idx")}).join(above, ["seq_id", "uf", "ui"], "left")
        at = saved(out.select("seq_id", "frame", "idx", F.col("next").alias("up"), F.coalesce("best", "top").alias("top")))
    heads = at.select("seq_id", "top").distinct().withColumn("track", F.row_number().over(Window.partitionBy("seq_id").orderBy("top")) - 1)
    return at.join(heads, ["seq_id", "top"]).select("seq_id", "frame", "idx", F.col("track").cast("long").alias("track"))
