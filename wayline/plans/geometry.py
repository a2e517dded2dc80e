"""Queries on quaternions, frames, cameras and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import consensus, folds, mapping, order, validate
from .common import EV, FIELDS, POSED, SYNC, estimates, events, query, synced

A, B = ("aw", "ax", "ay", "az"), ("dw", "dx", "dy", "dz")
#: A camera 90 degrees round from the body, and its place on it.
MOUNT = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
PLACE = (-0.02, -0.06, 0.01)
LENS = {"fx": 520.0, "fy": 515.0, "cx": 322.0, "cy": 239.0, "k1": -0.21, "k2": 0.05, "p1": 0.0004, "p2": 0.00003}


def element(i: int) -> str:
    return f"embedding[{i}]::DOUBLE"


def unit_sql(first: int, names) -> str:
    n = " + ".join(f"{element(i)} * {element(i)}" for i in range(first, first + 4))
    return ", ".join(f"{element(first + i)} / sqrt({n}) AS {c}" for i, c in enumerate(names))


QUATS = f"q AS (SELECT vec_id, {unit_sql(1, A)}, {unit_sql(5, B)}, {element(9)} AS vx, {element(10)} AS vy, {element(11)} AS vz FROM embeddings)"


def quats(spark, sf_dir):
    """vec_id, unit quaternions a and b and a vector v, of the first eleven elements."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = lambda i: F.col("embedding")[i].cast("double")
    a, b = g.q_normalize(tuple(e(i) for i in range(4))), g.q_normalize(tuple(e(i) for i in range(4, 8)))
    return rows.select("vec_id", *(c.alias(n) for n, c in zip(A + B, a + b, strict=True)), *(e(8 + i).alias(n) for i, n in enumerate(("vx", "vy", "vz"))))


def named(cols, names, digits=6):
    return [F.round(c, digits).alias(n) for n, c in zip(names, cols, strict=True)]


def mul(a: str, b: str) -> list[str]:
    q = lambda p: [f"{p}{c}" for c in "wxyz"]
    (aw, ax, ay, az), (bw, bx, by, bz) = q(a), q(b)
    return [f"({aw}*{bw} - {ax}*{bx} - {ay}*{by} - {az}*{bz})", f"({aw}*{bx} + {ax}*{bw} + {ay}*{bz} - {az}*{by})", f"({aw}*{by} - {ax}*{bz} + {ay}*{bw} + {az}*{bx})", f"({aw}*{bz} + {ax}*{by} - {ay}*{bx} + {az}*{bw})"]


def mat(a: str) -> list[list[str]]:
    w, x, y, z = (f"{a}{c}" for c in "wxyz")
    return [
        [f"(1 - 2*({y}*{y} + {z}*{z}))", f"(2*({x}*{y} - {w}*{z}))", f"(2*({x}*{z} + {w}*{y}))"],
        [f"(2*({x}*{y} + {w}*{z}))", f"(1 - 2*({x}*{x} + {z}*{z}))", f"(2*({y}*{z} - {w}*{x}))"],
        [f"(2*({x}*{z} - {w}*{y}))", f"(2*({y}*{z} + {w}*{x}))", f"(1 - 2*({x}*{x} + {y}*{y}))"],
    ]


def apply_sql(m, v) -> list[str]:
    return ["(" + " + ".join(f"{a} * {b}" for a, b in zip(row, v, strict=True)) + ")" for row in m]


def select(cols, names, digits=6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {n}" for n, c in zip(names, cols, strict=True))


Q4, V3 = ("qw", "qx", "qy", "qz"), ("x", "y", "z")
M9 = [f"m{i}{j}" for i in range(3) for j in range(3)]


@query(f"WITH {QUATS} SELECT vec_id, {select(mul('a', 'd'), Q4)} FROM q")
def quat_multiply(spark, sf_dir):
    return quats(spark, sf_dir).select("vec_id", *named(g.q_multiply(g.vec(*A), g.vec(*B)), Q4))


@query(f"WITH {QUATS} SELECT vec_id, {select([c for r in mat('a') for c in r], M9)} FROM q")
def quat_to_matrix(spark, sf_dir):
    return quats(spark, sf_dir).select("vec_id", *named([c for r in g.q_matrix(g.vec(*A)) for c in r], M9))


@query(f"WITH {QUATS} SELECT vec_id, {select([f'sign(aw) * a{c}' for c in 'wxyz'], Q4, 5)} FROM q")
def matrix_to_quat(spark, sf_dir):
    return quats(spark, sf_dir).select("vec_id", *named(g.q_from_matrix(g.q_matrix(g.vec(*A))), Q4, 5))


@query(f"WITH {QUATS} SELECT vec_id, {select(apply_sql(mat('a'), ['vx', 'vy', 'vz']), V3)} FROM q")
def rotate_vector(spark, sf_dir):
    return quats(spark, sf_dir).select("vec_id", *named(g.rotate(g.vec(*A), g.vec("vx", "vy", "vz")), V3))


@query(f"""WITH {QUATS}, d AS (SELECT *, aw*dw + ax*dx + ay*dy + az*dz AS d0 FROM q), s AS (SELECT *, CASE WHEN d0 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, acos(least(1.0::DOUBLE, abs(d0))) AS th FROM d),
 m AS (SELECT vec_id, {', '.join(f"CASE WHEN abs(d0) > 0.9995 THEN 0.7*a{c} + 0.3*sg*d{c} ELSE (sin(0.7*th)*a{c} + sin(0.3*th)*sg*d{c}) / sin(th) END AS r{c}" for c in "wxyz")} FROM s)
 SELECT vec_id, {', '.join(f"round(r{c} / sqrt(rw*rw + rx*rx + ry*ry + rz*rz), 6) AS q{c}" for c in "wxyz")} FROM m""")
def quat_slerp(spark, sf_dir):
    return quats(spark, sf_dir).select("vec_id", *named(g.q_slerp(g.vec(*A), g.vec(*B), 0.3), Q4))


@query(f"WITH {QUATS} SELECT vec_id, round(degrees(atan2(2*(aw*ax + ay*az), 1 - 2*(ax*ax + ay*ay))), 4) AS roll, round(degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 2*(aw*ay - az*ax))))), 4) AS pitch, round(degrees(atan2(2*(aw*az + ax*ay), 1 - 2*(ay*ay + az*az))), 4) AS yaw FROM q")
def quat_euler(spark, sf_dir):
    return quats(spark, sf_dir).select("vec_id", *named(g.q_euler(g.vec(*A)), ("roll", "pitch", "yaw"), 4))


@query(f"WITH {QUATS} SELECT vec_id, round(-vy + -0.02, 6) AS bx, round(vx + -0.06, 6) AS by_, round(vz + 0.01, 6) AS bz, round(vy + 0.06, 6) AS cx, round(-(vx + 0.02), 6) AS cy, round(vz - 0.01, 6) AS cz, round(-vy / sqrt(vx*vx + vy*vy + vz*vz), 6) AS dx, 0.06::DOUBLE AS ix FROM q")
def camera_body_transforms(spark, sf_dir):
    """Points from camera to body and back, a direction, and the first offset of the inverse transform."""
    m, t, v = g.constant(MOUNT), g.constant(PLACE), g.vec("vx", "vy", "vz")
    body, cam, way = g.camera_to_body(m, t, v), g.body_to_camera(m, t, v), g.direction_to_body(m, v)
    _, back = g.invert_transform(m, t)
    return quats(spark, sf_dir).select("vec_id", *named(body, ("bx", "by_", "bz")), *named(cam, ("cx", "cy", "cz")), F.round(way[0], 6).alias("dx"), F.round(back[0], 6).alias("ix"))


@query(f"WITH {QUATS} SELECT vec_id, " + select([mat("a")[1][1], f"-{mat('a')[1][0]}", mat("a")[2][2]], ("r00", "r01", "r22")) + " FROM q")
def relative_rotation_to_body(spark, sf_dir):
    r = g.relative_to_body(g.constant(MOUNT), g.q_matrix(g.vec(*A)))
    return quats(spark, sf_dir).select("vec_id", *named((r[0][0], r[0][1], r[2][2]), ("r00", "r01", "r22")))


@query(f"WITH {QUATS} SELECT vec_id, {select(['vx + ' + c for c in apply_sql(mat('a'), ['-0.02', '-0.06', '0.01'])[:1]] + ['vy + ' + apply_sql(mat('a'), ['-0.02', '-0.06', '0.01'])[1]] + [mat('a')[0][1]], ('px', 'py', 'r00'))} FROM q")
def camera_pose(spark, sf_dir):
    r, p = mapping.keyframe_pose(g.vec(*A), g.vec("vx", "vy", "vz"), g.constant(MOUNT), g.constant(PLACE))
    return quats(spark, sf_dir).select("vec_id", *named((p[0], p[1], r[0][0]), ("px", "py", "r00")))


@query(f"""WITH {QUATS}, d AS (SELECT vec_id, vx - 0.1 AS ax_, vy AS ay_, vz + 3 AS az_, vx + 0.1 AS bx_, vy AS by_, vz + 3 AS bz_ FROM q)
 SELECT vec_id, round(degrees(acos(least(1.0::DOUBLE, (ax_*bx_ + ay_*by_ + az_*bz_) / (sqrt(ax_*ax_ + ay_*ay_ + az_*az_) * sqrt(bx_*bx_ + by_*by_ + bz_*bz_))))), 4) AS degrees FROM d""")
def parallax_angle(spark, sf_dir):
    point = (F.col("vx"), F.col("vy"), F.col("vz") + 3)
    left, right = g.constant((0.1, 0, 0)), g.constant((-0.1, 0, 0))
    return quats(spark, sf_dir).select("vec_id", F.round(g.parallax(left, right, point), 4).alias("degrees"))


@query(f"""WITH {QUATS}, n AS (SELECT vec_id, vx / (vz + 3) AS x, vy / (vz + 3) AS y FROM q), r AS (SELECT *, x*x + y*y AS r2 FROM n)
 SELECT vec_id, round(520.0 * (x * (1 - 0.21*r2 + 0.05*r2*r2) + 0.0008*x*y + 0.00003*(r2 + 2*x*x)) + 322.0, 4) AS u, round(515.0 * (y * (1 - 0.21*r2 + 0.05*r2*r2) + 0.0004*(r2 + 2*y*y) + 0.00006*x*y) + 239.0, 4) AS v FROM r""")
def project_points(spark, sf_dir):
    u, v = g.project((F.col("vx"), F.col("vy"), F.col("vz") + 3), **LENS)
    return quats(spark, sf_dir).select("vec_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query(f"WITH {QUATS} SELECT vec_id, round(vx / (vz + 3), 4) AS x, round(vy / (vz + 3), 4) AS y FROM q WHERE abs(vx) < 1 AND abs(vy) < 1 AND vz > -1")
def undistort_points(spark, sf_dir):
    """Projected and distorted, then undistorted again: the normalized coordinates come back."""
    rows = quats(spark, sf_dir).where("abs(vx) < 1 and abs(vy) < 1 and vz > -1")
    u, v = g.project((F.col("vx"), F.col("vy"), F.col("vz") + 3), **LENS)
    x, y = g.undistort(F.col("u"), F.col("v"), **LENS, rounds=25)
    return rows.withColumns({"u": u, "v": v}).select("vec_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query(f"WITH {QUATS}, m AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'not orthonormal' WHEN vec_id % 5 = 1 THEN 'determinant' WHEN vec_id % 5 = 2 THEN 'non-finite' END AS fault FROM q) SELECT * FROM m")
def rotation_validation(spark, sf_dir):
    rows = quats(spark, sf_dir)
    flat = [c for r in g.q_matrix(g.vec(*A)) for c in r]
    k = F.col("vec_id") % 5
    bent = [F.when(k == 0, c * 1.1).when(k == 1, c * (-1.0 if i < 3 else 1.0)).when((k == 2) & F.lit(i == 4), float("nan")).otherwise(c) for i, c in enumerate(flat)]
    made = rows.select("vec_id", *(c.alias(n) for c, n in zip(bent, M9, strict=True)))
    return made.select("vec_id", validate.rotation_faults([F.col(n) for n in M9]).alias("fault"))


@query(f"WITH {QUATS} SELECT vec_id, round(sqrt(vx*vx + vy*vy + vz*vz), 6) AS magnitude, round(100 / (1 + exp(-vx)), 4) AS percent, CASE WHEN 1 / (1 + exp(-vx)) >= 0.5 THEN 'ACTIVE' ELSE 'STANDBY' END AS ml, CASE WHEN vec_id % 20 >= 10 THEN 'TRACKING' ELSE 'LOW' END AS vision FROM q")
def panel_labels(spark, sf_dir):
    c = 1 / (1 + F.exp(-F.col("vx")))
    return quats(spark, sf_dir).select("vec_id", F.round(g.norm(g.vec("vx", "vy", "vz")), 6).alias("magnitude"), F.round(100 * c, 4).alias("percent"), F.when(c >= 0.5, "ACTIVE").otherwise("STANDBY").alias("ml"), F.when(F.col("vec_id") % 20 >= 10, "TRACKING").otherwise("LOW").alias("vision"))


RULES = """CASE WHEN parallax < 1 THEN 'REJECTED_PARALLAX' WHEN z0 <= 0 OR z1 <= 0 THEN 'REJECTED_NEGATIVE_DEPTH' WHEN least(z0, z1) < 0.1 OR greatest(z0, z1) > 50 THEN 'REJECTED_DEPTH_RANGE' WHEN e0 > 2 OR e1 > 2 THEN 'REJECTED_REPROJECTION' ELSE 'SUCCESS' END"""
TRIES = f"tries AS (SELECT user_id AS track, event_id AS kf, value, k, value / 100 AS parallax, k / 10.0::DOUBLE - 1 AS z0, value / 8 - 1 AS z1, (k % 30) / 10.0::DOUBLE AS e0, (k % 7) / 3.0::DOUBLE AS e1 FROM (SELECT user_id, event_id, value, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::BIGINT AS k FROM events)), judged AS (SELECT *, {RULES} AS status FROM tries)"


def judged(spark, sf_dir):
    rows = events(spark, sf_dir)
    v, k = F.col("value"), F.col("k")
    rows = rows.select(F.col("seq_id").alias("track"), F.col("event_id").alias("kf"), "us", (v / 100).alias("parallax"), (k / 10.0 - 1).alias("z0"), (v / 8 - 1).alias("z1"), ((k % 30) / 10.0).alias("e0"), ((k % 7) / 3.0).alias("e1"))
    status = mapping.acceptance(F.col("parallax"), F.col("z0"), F.col("z1"), F.col("e0"), F.col("e1"), g.vec("z0", "z1", "e0"))
    return rows.withColumn("status", status)


@query(f"WITH {TRIES} SELECT status, count(*) AS n, round(avg((e0 + e1) / 2), 6) AS mean_error FROM judged GROUP BY status")
def reject_reasons(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg((F.col("e0") + F.col("e1")) / 2), 6).alias("mean_error"))


@query(f"WITH {TRIES} SELECT count(*) AS attempts, count(*) FILTER (status = 'SUCCESS') AS landmarks, count(*) FILTER (status <> 'SUCCESS') AS rejected, round(avg((e0 + e1) / 2) FILTER (status = 'SUCCESS'), 6) AS mean_error, round(median((e0 + e1) / 2) FILTER (status = 'SUCCESS'), 6) AS median_error, round(min(z0) FILTER (status = 'SUCCESS'), 6) AS min_depth, round(max(z0) FILTER (status = 'SUCCESS'), 6) AS max_depth FROM judged")
def mapping_statistics(spark, sf_dir):
    ok = F.col("status") == "SUCCESS"
    e = F.when(ok, (F.col("e0") + F.col("e1")) / 2)
    z = F.when(ok, F.col("z0"))
    rows = judged(spark, sf_dir).select(ok.alias("ok"), e.alias("e"), z.alias("z"))
    aggs = [F.count("*").alias("attempts"), F.count_if("ok").alias("landmarks"), F.count_if(~F.col("ok")).alias("rejected"), F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.min("z"), 6).alias("min_depth"), F.round(F.max("z"), 6).alias("max_depth")]
    out = order.summarize(rows, [], aggs, {"median_error": ("e", 0.5)})
    return out.withColumn("median_error", F.round("median_error", 6))


@query(f"WITH {TRIES}, d AS (SELECT track, min(kf) FILTER (status = 'SUCCESS') AS done FROM judged GROUP BY track) SELECT track, any_value(done) AS kf, count(*) AS attempts FROM judged JOIN d USING (track) WHERE done IS NULL OR kf <= done GROUP BY track")
def map_building(spark, sf_dir):
    return mapping.first_success(judged(spark, sf_dir))


@query(f"WITH {TRIES}, f AS (SELECT track, kf, e0, first_value(kf) OVER (PARTITION BY track ORDER BY kf) AS first_kf, first_value(e0) OVER (PARTITION BY track ORDER BY kf) AS first_e FROM judged) SELECT track, kf, first_kf, round(e0 - first_e, 6) AS change FROM f WHERE kf > first_kf")
def first_observation_join(spark, sf_dir):
    rows = mapping.with_first_observation(judged(spark, sf_dir).select("track", "kf", "e0"))
    return rows.select("track", "kf", F.col("first.kf").alias("first_kf"), F.round(F.col("e0") - F.col("first.e0"), 6).alias("change"))


@query(f"""WITH {TRIES}, c AS (SELECT track AS id, arg_min(e0, kf) AS error, min(kf) AS us FROM judged GROUP BY track), u AS (SELECT j.track AS id, e1, kf FROM judged j JOIN c ON c.id = j.track AND j.kf > c.us WHERE z1 > 0 AND e1 <= 1)
 SELECT c.id, 2 + count(u.kf) AS observations, round((2 * any_value(error) + coalesce(sum(e1), 0)) / (2 + count(u.kf)), 6) AS mean_error, greatest(any_value(us), max(kf)) AS last_us FROM c LEFT JOIN u USING (id) GROUP BY c.id""")
def landmark_running_mean(spark, sf_dir):
    rows = judged(spark, sf_dir)
    created = rows.groupBy(F.col("track").alias("id")).agg(F.min_by("e0", "kf").alias("error"), F.min("kf").alias("us"))
    later = rows.join(created.select(F.col("id").alias("track"), F.col("us").alias("born")), "track").where("kf > born")
    updates = later.select(F.col("track").alias("id"), F.col("e1").alias("error"), F.col("z1").alias("z"), F.col("kf").alias("us"))
    return mapping.landmark_upkeep(created, updates, 1.0).select("id", "observations", F.round("mean_error", 6).alias("mean_error"), "last_us")


@query(f"WITH {EV}, c AS (SELECT seq_id, event_id AS id, row_number() OVER (PARTITION BY seq_id ORDER BY us, event_id) AS n FROM ev) SELECT * FROM c WHERE n <= 4")
def capacity_limit(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq_id", "us", F.col("event_id").alias("id"))
    return mapping.first_landmarks(rows, 4).select("seq_id", "id", F.col("n").cast("long").alias("n"))


@query(f"WITH {QUATS} SELECT vec_id, round(vx, 4) AS x, round(vy, 4) AS y, round(vz + 4, 4) AS z FROM q WHERE abs(vx) < 2 AND abs(vy) < 2 AND abs(vz) < 2")
def triangulate_dlt(spark, sf_dir):
    """Points seen from two cameras a step apart, found again by the direct linear transform."""
    rows = quats(spark, sf_dir).where("abs(vx) < 2 and abs(vy) < 2 and abs(vz) < 2").withColumn("d", F.col("vz") + 4)
    flat = lambda shift: F.array(*(F.lit(float(x)) for x in (1, 0, 0, shift, 0, 1, 0, 0, 0, 0, 1, 0)))
    seen = lambda shift: F.array((F.col("vx") + shift) / F.col("d"), F.col("vy") / F.col("d"))
    made = rows.select("vec_id", flat(0.0).alias("p0"), flat(-0.5).alias("p1"), seen(0.0).alias("x0"), seen(-0.5).alias("x1"))
    return mapping.triangulate(made, "p0", "p1", "x0", "x1").select("vec_id", *(F.round(c, 4).alias(c) for c in "xyz"))


def brisk(samples: str):
    """Days between events as seconds between samples."""
    return F.transform(samples, lambda s: F.struct((s["us"] / 100_000).cast("long").alias("us"), *(s[c].alias(c) for c in FIELDS if c != "event_id")))


TURN = {"x": "qy * tz - qz * ty", "y": "qz * tx - qx * tz", "z": "qx * ty - qy * tx"}


@query(f"""WITH RECURSIVE {SYNC},
 n AS (SELECT seq_id, us, sus, ax, ay, az, wx, wy, wz, sus // 100000 AS b, row_number() OVER w AS r, count(*) OVER (PARTITION BY seq_id, us) AS n, lead(sus // 100000) OVER w AS nb FROM j WHERE event_id IS NOT NULL WINDOW w AS (PARTITION BY seq_id, us ORDER BY sus, event_id)),
 d AS (SELECT *, CASE WHEN n = 1 THEN 0.005::DOUBLE ELSE (nb - b) * 1e-6::DOUBLE END AS dt, sqrt(wx*wx + wy*wy + wz*wz) AS size FROM n WHERE n = 1 OR nb IS NOT NULL),
 st AS (SELECT seq_id, us, r, ax, ay, az, dt, cos(size * dt / 2) AS cw, {', '.join(f'w{c} * CASE WHEN size * dt > 1e-8 THEN sin(size * dt / 2) / size ELSE dt / 2 END AS d{c}' for c in 'xyz')} FROM d),
 z AS (SELECT seq_id, us, 0::BIGINT AS r, {', '.join(f'0::DOUBLE AS {c}' for c in ('px', 'py', 'pz', 'vx', 'vy', 'vz'))}, 1::DOUBLE AS qw, 0::DOUBLE AS qx, 0::DOUBLE AS qy, 0::DOUBLE AS qz FROM f
  UNION ALL
  SELECT seq_id, us, r, {', '.join(f'p{c} + v{c} * dt + 0.5::DOUBLE * g{c} * dt * dt' for c in 'xyz')}, {', '.join(f'v{c} + g{c} * dt' for c in 'xyz')}, {', '.join(f'n{c} / sqrt(nw*nw + nx*nx + ny*ny + nz*nz)' for c in 'wxyz')}
  FROM (SELECT *, {', '.join(f"a{c} + qw * t{c} + {TURN[c]}{' + 9.81::DOUBLE' if c == 'z' else ''} AS g{c}" for c in 'xyz')},
   qw*cw - qx*dx - qy*dy - qz*dz AS nw, qw*dx + cw*qx + qy*dz - qz*dy AS nx, qw*dy + cw*qy + qz*dx - qx*dz AS ny, qw*dz + cw*qz + qx*dy - qy*dx AS nz
   FROM (SELECT z.seq_id, z.us, s.r, px, py, pz, vx, vy, vz, qw, qx, qy, qz, ax, ay, az, dt, cw, dx, dy, dz, 2 * (qy*az - qz*ay) AS tx, 2 * (qz*ax - qx*az) AS ty, 2 * (qx*ay - qy*ax) AS tz
    FROM z JOIN st s ON s.seq_id = z.seq_id AND s.us = z.us AND s.r = z.r + 1)))
 SELECT seq_id, us, {select(folds.STATE, folds.STATE, 4)} FROM z QUALIFY row_number() OVER (PARTITION BY seq_id, us ORDER BY r DESC) = 1""")
def imu_fold(spark, sf_dir):
    """State after each interval from rest, folded over its nested samples."""
    out = folds.integrate(synced(spark, sf_dir).withColumn("samples", brisk("samples")), "seq_id", "us")
    return out.select("seq_id", "us", *(F.round(c, 4).alias(c) for c in folds.STATE))


def visual(spark, sf_dir):
    """Synced intervals with a visual result: a small turn and a heading, where it succeeded."""
    rows = synced(spark, sf_dir)
    near = brisk("samples")
    turn = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), ((F.col("us") % 100) / 10000.0))
    return rows.select("seq_id", (F.col("us") / 100_000).cast("long").alias("us"), near.alias("samples"), ((F.col("us") % 3) > 0).alias("success"), turn.alias("turn"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("heading"))


@query()
def fusion_trajectory(spark, sf_dir):
    return folds.fuse(visual(spark, sf_dir))


@query(f"""WITH RECURSIVE {EV}, {POSED}, c AS (SELECT *, event_id % 40 AS features, row_number() OVER (PARTITION BY seq_id ORDER BY us) AS r FROM posed WHERE event_type = 'click'),
 w AS (SELECT seq_id, us, r, 0 AS keyframe, true AS taken, {', '.join(f'{c} AS l_{c}' for c in folds.POSE)} FROM c WHERE r = 1
  UNION ALL
  SELECT seq_id, us, r, keyframe + take::INT, take, {', '.join(f'CASE WHEN take THEN {c} ELSE l_{c} END' for c in folds.POSE)}
  FROM (SELECT *, features >= 10 AND (moved >= 20 OR turned >= 40 OR (r - keyframe * 5 >= 5 AND moved >= 1)) AS take
   FROM (SELECT c.*, w.keyframe, {', '.join(f'w.l_{c}' for c in folds.POSE)}, sqrt({' + '.join(f'pow(c.{p} - w.l_{p}, 2)' for p in ('px', 'py', 'pz'))}) AS moved,
    degrees(2 * acos(least(1.0::DOUBLE, abs({' + '.join(f'c.{q} * w.l_{q}' for q in Q4)})))) AS turned FROM w JOIN c ON c.seq_id = w.seq_id AND c.r = w.r + 1)))
 SELECT seq_id, us, keyframe::BIGINT AS keyframe FROM w WHERE taken""")
def keyframes(spark, sf_dir):
    rows = estimates(spark, sf_dir).withColumn("features", F.col("event_id") % 40)
    return folds.key_frames(rows, distance=20.0, degrees=40.0, interval=5, little=1.0, least=10)


SEEN = f"""{QUATS}, t AS (SELECT vec_id AS track, vx AS x, vy AS y, (vec_id % 8 - 1) * 9 + 4 + vz AS z FROM q WHERE abs(vx) < 2 AND abs(vy) < 2 AND abs(vz) < 3),
 a AS (SELECT t.*, kf, 0.1::DOUBLE * kf * kf AS c FROM t, range(1, 5) k(kf)),
 b AS (SELECT *, degrees(acos(least(1.0::DOUBLE, (x * (x - c) + y * y + z * z) / (sqrt(x*x + y*y + z*z) * sqrt((x-c)*(x-c) + y*y + z*z))))) >= 1 AND z > 0 AND z >= 0.1 AND z <= 50 AS ok FROM a),
 d AS (SELECT track, min(kf) FILTER (ok) AS done FROM b GROUP BY track)"""


@query(f"""WITH {SEEN} SELECT track, any_value(done) AS kf, count(*) FILTER (done IS NULL OR b.kf <= done) AS attempts, {', '.join(f'round(any_value({c}) FILTER (done IS NOT NULL), 4) AS {c}' for c in 'xyz')},
 round(any_value(z) FILTER (done IS NOT NULL), 4) AS depth, any_value(0::DOUBLE) FILTER (done IS NOT NULL) AS error FROM b JOIN d USING (track) GROUP BY track""")
def map_triangulation(spark, sf_dir):
    """Points at eight depths, one of them behind the cameras, seen by five that move aside and roll: found again
    once the angle is wide enough."""
    rows = quats(spark, sf_dir).where("abs(vx) < 2 and abs(vy) < 2 and abs(vz) < 3")
    k = F.col("kf")
    rows = rows.withColumns({"x": F.col("vx"), "y": F.col("vy"), "z": (F.col("vec_id") % 8 - 1) * 9 + 4 + F.col("vz"), "kf": F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>"))})
    cos, sin, zero, one = F.cos(0.1 * k), F.sin(0.1 * k), F.lit(0.0), F.lit(1.0)
    roll = ((cos, -sin, zero), (sin, cos, zero), (zero, zero, one))
    place = (0.1 * k * k, zero, zero)
    u, v = g.project(g.body_to_camera(roll, place, g.vec("x", "y", "z")), **LENS)
    obs = rows.select(F.col("vec_id").alias("track"), "kf", F.array(*(e for r in roll for e in r)).alias("r"), F.array(*place).alias("c"), u.alias("u"), v.alias("v"))
    out = mapping.build_map(obs, LENS, rounds=25)
    return out.select("track", "kf", "attempts", *(F.round(c, 4).alias(c) for c in ("x", "y", "z", "depth")), F.round(F.abs("error"), 4).alias("error"))


PINHOLE = {c: LENS[c] for c in ("fx", "fy", "cx", "cy")}
POINTS3 = " UNION ALL ".join(f"SELECT vec_id, vec_id * 4 + {j} AS idx, 8 * {element(3 * j + 1)} AS x, 8 * {element(3 * j + 2)} AS y, 6 + 8 * {element(3 * j + 3)} AS z FROM embeddings" for j in range(4))


@query(f"""WITH p AS ({POINTS3}), m AS (SELECT vec_id // 500 AS seq_id, (vec_id % 500) // 50 AS frame, idx, x, y, z FROM p),
 k AS (SELECT *, cos(0.03 + 0.01 * (frame % 4)) AS ca, sin(0.03 + 0.01 * (frame % 4)) AS sa, cos(0.15 * (frame % 5)) AS tx, sin(0.15 * (frame % 5)) AS tz FROM m WHERE frame <> 7 OR idx % 60 = 0),
 v AS (SELECT *, x / z AS x0, y / z AS y0, (ca*x + sa*z + 0.5*tx) / (ca*z - sa*x + 0.5*tz) AS x1,
  y / (ca*z - sa*x + 0.5*tz) + CASE WHEN idx % 10 IN (0, 3, 7) OR (frame = 6 AND idx % 10 > 0) THEN (40 + 7 * (idx % 5)) * CASE WHEN idx % 3 = 0 THEN -1 ELSE 1 END / 515::DOUBLE ELSE 0 END AS y1 FROM k),
 e AS (SELECT *, -tz*y0 AS e0, (tz*ca + tx*sa)*x0 + tz*sa - tx*ca AS e1, tx*y0 AS e2, (tz*ca + tx*sa)*y1 AS b0, tx - tz*x1 AS b1 FROM v),
 c AS (SELECT seq_id, frame, count(*) AS tracked, count(*) FILTER (pow(x1*e0 + y1*e1 + e2, 2) / (e0*e0 + e1*e1 + b0*b0 + b1*b1) <= pow(1 / 517.5::DOUBLE, 2)) AS near,
  any_value(ca) AS ca, any_value(sa) AS sa, any_value(tx) AS tx, any_value(tz) AS tz FROM e GROUP BY ALL),
 s AS (SELECT *, CASE WHEN tracked < 60 THEN 'insufficient' WHEN frame = 9 THEN 'non-finite' WHEN frame = 8 THEN 'degenerate' WHEN near < 60 THEN 'few inliers' ELSE 'ok' END AS status FROM c)
 SELECT seq_id, frame, status = 'ok' AS success, tracked, CASE WHEN status = 'ok' THEN near END AS inliers, CASE WHEN status = 'ok' THEN near END AS front, status,
  {', '.join(f"round(CASE WHEN status = 'ok' THEN {e} END, 4) AS r{i}" for i, e in enumerate(('ca', '0::DOUBLE', 'sa', '0::DOUBLE', '1::DOUBLE', '0::DOUBLE', '-sa', '0::DOUBLE', 'ca')))},
  {', '.join(f"round(CASE WHEN status = 'ok' THEN {e} END, 4) AS {n}" for n, e in (('tx', 'tx'), ('ty', '0::DOUBLE'), ('tz', 'tz')))} FROM s""")
def relative_motion(spark, sf_dir):
    """Points seen from two views that turn and move, a third of them displaced; some frames have too few
    points, no spread, a NaN, or more displaced points than not."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = lambda i: 8 * F.col("embedding")[i].cast("double")
    made = F.array(*(F.struct((F.col("vec_id") * 4 + j).alias("idx"), e(3 * j).alias("x"), e(3 * j + 1).alias("y"), (6 + e(3 * j + 2)).alias("z")) for j in range(4)))
    rows = rows.select(F.floor(F.col("vec_id") / 500).alias("seq_id"), F.floor(F.col("vec_id") % 500 / 50).alias("frame"), F.inline(made))
    frame, idx = F.col("frame"), F.col("idx")
    turn, way = 0.03 + 0.01 * (frame % 4), 0.15 * (frame % 5)
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = ((F.cos(turn), zero, F.sin(turn)), (zero, one, zero), (-F.sin(turn), zero, F.cos(turn)))
    there = g.add(g.m_apply(matrix, g.vec("x", "y", "z")), (0.5 * F.cos(way), zero, 0.5 * F.sin(way)))
    (u0, v0), (u1, v1) = g.project(g.vec("x", "y", "z"), **PINHOLE), g.project(there, **PINHOLE)
    off = F.when((idx % 10).isin(0, 3, 7) | ((frame == 6) & (idx % 10 > 0)), (40 + 7 * (idx % 5)) * F.when(idx % 3 == 0, -1).otherwise(1)).otherwise(0)
    rows = rows.where((frame != 7) | (idx % 60 == 0)).select("seq_id", "frame", "idx", F.when(frame == 8, 100.0).otherwise(u0).alias("u0"), v0.alias("v0"), F.when((frame == 9) & (idx % 97 == 5), float("nan")).otherwise(u1).alias("u1"), (v1 + off).alias("v1"))
    out = consensus.relative_motion(rows, **PINHOLE, least=60)
    found = [F.when(F.col("success"), F.col(c)).alias(c) for c in ("inliers", "front")]
    return out.select("seq_id", "frame", "success", "tracked", *found, "status", *(F.round(F.col("r")[i], 4).alias(f"r{i}") for i in range(9)), *(F.round(F.col("t")[i], 4).alias(n) for i, n in enumerate(("tx", "ty", "tz"))))
