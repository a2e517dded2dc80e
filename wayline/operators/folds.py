"""Ordered folds: inertial integration, state machines, key frames, fusion, gated correction."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import inertial
from .inertial import GRAVITY, NOMINAL_DT, STATE
from .prefix import HOUR, first_value, in_spans, running_count, running_sum, scan

#: What a fold over intervals needs besides: the steps' time, and number and sums of finite specific forces.
TOTALS = ("dt", "n_ok", "fx", "fy", "fz")


def integrate(rows: DataFrame, *keys: str, totals: bool = False) -> DataFrame:
    """keys and the state (STATE) after integrating each row's samples (array of us, ax..az, wx..wz, by
    time) from rest: the steps of all rows of an Arrow batch are combined together, pair by pair. With totals
    also TOTALS. For intervals too long for an array see inertial.integrate_rows.

    n samples give n - 1 steps, each of the time to the next; one sample alone has a nominal step.
    """

    names = STATE + TOTALS if totals else STATE

    def run(batches):
        for batch in batches:
            lists = batch.column("samples")
            if lists.null_count:
                lists = pc.fill_null(lists, pa.scalar([], lists.type))
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            get = lambda *names: np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)  # noqa: B023, E731
            us = flat.field("us").to_numpy(zero_copy_only=False)
            force, rate = get("ax", "ay", "az"), get("wx", "wy", "wz")
            owner = np.repeat(np.arange(len(n)), n)
            lone, last = n[owner] == 1, np.zeros(len(owner), bool)
            last[np.cumsum(n)[n > 0] - 1] = True
            on = np.flatnonzero(lone | ~last)  # n samples make n - 1 steps
            gap = np.where(lone[on], NOMINAL_DT, (us[np.minimum(on + 1, len(us) - 1)] - us[on]) * 1e-6) if len(on) else np.zeros(0)
            whole, heads = inertial.reduced(inertial.steps(force[on], rate[on], gap), owner[on])
            elements = inertial.identity(len(n))
            elements[heads] = whole
            state, time = inertial.fallen(elements), elements[:, 10]
            if totals:
                ok = np.isfinite(force).all(axis=1)
                sums = [np.bincount(owner, ok, len(n)), *(np.bincount(owner, np.where(ok, force[:, i], 0), len(n)) for i in range(3))]
                state = np.column_stack([state, time, *sums])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array(state[:, i].copy()) for i in range(len(names)))], [*keys, *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*keys, "samples").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), *(f"{c} double" for c in names)]))


#: Health states.
INITIALIZING, TRACKING, DEGRADED, LOST = "INITIALIZING", "TRACKING", "DEGRADED", "LOST"


def health_step(state, count, valid, ready, visual, features, least: int, timeout: int):
    """Next (state, count) of the health machine for one observation; plain values."""
    if not valid:
        return LOST, 0
    good = visual and features >= least
    if state == INITIALIZING:
        return (TRACKING if ready and features >= least else INITIALIZING), count
    if state == TRACKING:
        return (TRACKING, count) if good else (DEGRADED, 1)
    if state == DEGRADED:
        if good:
            return TRACKING, 0
        return (LOST, 0) if count >= timeout else (DEGRADED, count + 1)
    return LOST, count


#: What health_maps gives of a span's rows.
MAP = ("invalid", "n", "lead", "after_lost", "after_tail", "begun", "begun_lost", "begun_tail")


def mapped_health(state: str, count: int, m: dict, timeout: int) -> tuple[str, int]:
    """The state and count that a span of rows, as one of health_maps, leads to from state and count."""
    degraded = lambda lost, tail: (LOST, 0) if lost else (DEGRADED, tail) if tail else (TRACKING, 0)
    if m["invalid"] or state == LOST:
        return LOST, 0
    if state == INITIALIZING:
        return degraded(m["begun_lost"], m["begun_tail"]) if m["begun"] else (INITIALIZING, 0)
    if count + m["lead"] > timeout:
        return LOST, 0
    if m["lead"] == m["n"]:
        return degraded(False, count + m["n"])
    return degraded(m["after_lost"], m["after_tail"])


def health_maps(rows: DataFrame, timeout: int) -> DataFrame:
    """seq_id, _span and MAP: the map from state to state that the rows of a span are, whatever comes before.

    From a tracking or degraded state, lead rows pass before the first good one, and what follows doesn't
    depend on the count; from the initial state, all depends on the first ready row. A run's length is the
    number of bad rows so far, less that at the last good one.
    """
    w = Window.partitionBy("seq_id", "_span").orderBy("us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fine = F.col("good") & F.col("started") | F.col("first")
    rows = rows.withColumns({"bads": F.count(F.when(~F.col("good"), 1)).over(upto), "readies": F.count(F.when(F.col("set_up"), 1)).over(upto)})
    rows = rows.withColumns({"started": F.col("readies") > 0, "first": F.col("set_up") & (F.col("readies") == 1)})
    rows = rows.withColumns({"run": F.col("bads") - F.max(F.when(F.col("good"), F.col("bads"))).over(upto), "begun_bads": F.count(F.when(F.col("started") & ~fine, 1)).over(upto)})
    rows = rows.withColumn("begun_run", F.col("begun_bads") - F.max(F.when(fine, F.col("begun_bads"))).over(upto))
    measures = {
        "invalid": F.bool_or(~F.col("valid")),
        "n": F.count(F.lit(1)),
        "lead": F.count(F.when(F.col("run").isNull(), 1)),
        "after_lost": F.coalesce(F.max(F.col("run") > timeout), F.lit(False)),
        "after_tail": F.coalesce(F.max_by("run", "us"), F.lit(0)),
        "begun": F.max("started"),
        "begun_lost": F.coalesce(F.max(F.col("begun_run") > timeout), F.lit(False)),
        "begun_tail": F.coalesce(F.max_by("begun_run", "us"), F.lit(0)),
    }
    return rows.groupBy("seq_id", "_span").agg(*(measures[c].alias(c) for c in MAP))


def health_states(rows: DataFrame, least: int = 10, timeout: int = 50, span: int = HOUR, start: DataFrame | None = None) -> DataFrame:
    """seq_id, us, state, count of every row (seq_id, us, valid, ready, visual, features), in time order.

    A scan over spans: what a span's rows do to any state is one row (health_maps), these are passed through in
    order, one row per span, and each span's rows are read off windows given the state that it begins with.
    start (seq_id, state, count) are the states of sequences to go on from, as last_health gives them;
    sequences that it hasn't begin anew. Flags that are null count as false, null validity as invalid.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    enough = F.col("features") >= least
    rows = in_spans(rows, span).select("seq_id", "us", "_span", yes(F.col("valid")).alias("valid"), yes(F.col("visual") & enough).alias("good"), yes(F.col("ready") & enough).alias("set_up"))
    maps = health_maps(rows, timeout)
    if start is not None:
        maps = maps.join(start.select("seq_id", F.col("state").alias("start_state"), F.col("count").cast("long").alias("start_count")), "seq_id", "left")
    else:
        maps = maps.withColumns({"start_state": F.lit(None).cast("string"), "start_count": F.lit(None).cast("long")})

    def run(batches):
        seq, state, count = None, INITIALIZING, 0
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                if m["seq_id"] != seq:
                    seq, state, count = m["seq_id"], m["start_state"] or INITIALIZING, m["start_count"] or 0
                out.append((seq, m["_span"], state, count))
                state, count = mapped_health(state, count, m, timeout)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["seq_id", "_span", "began", "began_count"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    began = maps.withColumn("seq_id", F.col("seq_id").cast("long")).repartition(parts, "seq_id").sortWithinPartitions("seq_id", "_span").mapInArrow(run, "seq_id long, _span long, began string, began_count long")
    rows = rows.join(began, ["seq_id", "_span"])
    w = Window.partitionBy("seq_id", "_span").orderBy("us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("began") == INITIALIZING
    rows = rows.withColumn("readies", F.count(F.when(F.col("set_up"), 1)).over(upto))
    rows = rows.withColumn("started", ~fresh | (F.col("readies") > 0))
    # the row that starts tracking counts as good whatever its visual flag is
    rows = rows.withColumn("fine", F.col("started") & (F.col("good") | (fresh & F.col("set_up") & (F.col("readies") == 1))))
    rows = rows.withColumn("bads", F.count(F.when(F.col("started") & ~F.col("fine"), 1)).over(upto))
    rows = rows.withColumn("run", F.coalesce(F.col("bads") - F.max(F.when(F.col("fine"), F.col("bads"))).over(upto), F.col("bads") + F.col("began_count")))
    bad = F.col("started") & ~F.col("fine")
    ends = ~F.col("valid") | (bad & (F.col("run") > timeout))
    rows = rows.withColumn("lost", (F.col("began") == LOST) | F.max(ends).over(upto))
    state = F.when(F.col("lost"), LOST).when(~F.col("started"), INITIALIZING).when(bad, DEGRADED).otherwise(TRACKING)
    count = F.when(F.col("lost") | ~bad, 0).otherwise(F.col("run"))
    return rows.select("seq_id", "us", state.alias("state"), count.cast("long").alias("count"))


def last_health(states: DataFrame) -> DataFrame:
    """seq_id, state, count that each sequence ends with, for a later run to start from."""
    return states.groupBy("seq_id").agg(F.max_by(F.struct("state", "count"), "us").alias("s")).select("seq_id", "s.*")


def gated_correction(rows: DataFrame, every: int, span: int = HOUR) -> DataFrame:
    """Corrected position where every n-th row is scored: scored rows advance the corrected position by
    their own v * dt, others put out the raw position and leave it.

    rows: seq_id, us, px, vx, dt (one axis); adds row and hybrid_px.
    """
    rows = scan(rows, span, row=running_count(), _start=first_value(F.col("px"))).withColumn("row", F.col("row") - 1)
    scored = F.col("row") % every == 0
    step = F.when(scored & (F.col("row") > 0), F.col("vx") * F.col("dt")).otherwise(0.0)
    rows = scan(rows, span, _moved=running_sum(step))
    return rows.withColumn("hybrid_px", F.when(scored, F.col("_start") + F.col("_moved")).otherwise(F.col("px"))).drop("_start", "_moved")


def quat(axis_rows):
    w, x, y, z = axis_rows
    return np.array([w, x, y, z], float) / np.linalg.norm([w, x, y, z])


def np_product(a, b):
    return np.array([a[0] * b[0] - a[1:] @ b[1:], *(a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:]))])


def np_rotate(q, v):
    t = 2 * np.cross(q[1:], v)
    return v + q[0] * t + np.cross(q[1:], t)


def np_slerp(a, b, t):
    d = a @ b
    b, d = (b, d) if d >= 0 else (-b, -d)
    if d > 0.9995:
        out = (1 - t) * a + t * b
    else:
        angle = np.arccos(min(1.0, d))
        out = (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)
    return out / np.linalg.norm(out)


def level(accel: np.ndarray) -> np.ndarray:
    ax, ay, az = accel
    roll, pitch = np.arctan2(-ay, -az), np.arctan2(ax, np.hypot(ay, az))
    cr, sr, cp, sp = np.cos(roll / 2), np.sin(roll / 2), np.cos(pitch / 2), np.sin(pitch / 2)
    return np.array([cr * cp, sr * cp, cr * sp, -sr * sp])


def advance(p, v, q, samples):
    """One interval of inertial steps over rows (us, ax..az, wx..wz)."""
    n = len(samples)
    for i in range(max(n - 1, min(n, 1))):
        dt = (samples[i + 1][0] - samples[i][0]) * 1e-6 if n > 1 else NOMINAL_DT
        a = np_rotate(q, samples[i][1:4]) + np.array([0, 0, GRAVITY])
        w = samples[i][4:7]
        rate = np.linalg.norm(w)
        half = rate * dt / 2
        dq = np.array([np.cos(half), *(w * (np.sin(half) / rate if rate * dt > 1e-8 else dt / 2))])
        p, v = p + v * dt + 0.5 * a * dt * dt, v + a * dt
        q = np_product(q, dq)
        q = q / np.linalg.norm(q)
    return p, v, q


FUSED = "seq_id long, us long, px double, py double, pz double, vx double, vy double, vz double, qw double, qx double, qy double, qz double, status string"


def fuse(rows: DataFrame, rotation_weight: float = 0.5, direction_weight: float = 0.5, level_after: int = 5) -> DataFrame:
    """Trajectory of each sequence, from its rest on to its end; see fuse_on."""
    return fuse_on(rows, None, rotation_weight, direction_weight, level_after).where("status <> 'STATE'").select(*(f.split()[0] for f in FUSED.split(", ")))


def fusion_ends(fused: DataFrame) -> DataFrame:
    """seq_id, state of the sequences that fuse_on has put out, for it to go on from."""
    return fused.where("status = 'STATE'").select("seq_id", "state")


def fuse_on(rows: DataFrame, start: DataFrame | None, rotation_weight: float = 0.5, direction_weight: float = 0.5, level_after: int = 5, hold: bool = False) -> DataFrame:
    """Trajectory of each sequence from rows (seq_id, us, samples, success, turn (quaternion of the body's
    visual rotation), heading (unit direction in the body frame)).

    Intervals are integrated from rest first, all in parallel. What is sequential by nature, orientation
    mixing visual and inertial turns, is left as a few sums for each row, carried from row to row over rows
    sorted by sequence and time, so that a task holds one batch whatever a sequence's length. Starts at
    rest; once level_after samples came, roll and pitch are set from them.

    Each sequence ends with a row of status STATE whose `state` says all that is carried along. start (seq_id,
    state) are states to go on from; a sequence without one starts anew, so no row there is a reset. With hold,
    the row of a sequence that isn't levelled yet is kept back in its state, for a later run to put out.
    """
    names = [*(f.split()[0] for f in FUSED.split(", ")), "state"]
    held = lambda x: tuple(map(held, x)) if isinstance(x, list) else x

    def ended(now, out):
        if now["first"] is not None and not hold:
            out.append((*now["first"], None))
        out.append((now["seq"], now["last"], *now["p"], *now["v"], *now["q"], "STATE", json.dumps(now)))

    def steps(rows, now, out):
        """Extends now, the state carried along, by rows; finished rows go to out."""
        for seq, us, success, turn, heading, past, px, py, pz, vx, vy, vz, *q, dt, n, fx, fy, fz in rows:
            if now is None or now["seq"] != seq:
                if now is not None:
                    ended(now, out)
                now = None if past is None else {k: held(x) for k, x in json.loads(past).items()}
            if now is None:
                now = {"seq": seq, "last": us, "p": (0.0, 0.0, 0.0), "v": (0.0, 0.0, 0.0), "q": (1.0, 0.0, 0.0, 0.0), "n": 0.0, "f": (0.0, 0.0, 0.0)}
                now["first"] = (seq, us, *now["p"], *now["v"], *now["q"], "INITIALIZED")
                continue
            if now["first"] is not None:  # not levelled yet
                now["n"], now["f"] = now["n"] + n, (now["f"][0] + fx, now["f"][1] + fy, now["f"][2] + fz)
                mean = [x / max(now["n"], 1.0) for x in now["f"]]
                if now["n"] >= level_after and sum(x * x for x in mean) ** 0.5 >= 1e-4:
                    now["q"] = tuple(level(np.array(mean)).tolist())
                    # the row put out before is the state from which levelling starts
                    first = now["first"]
                    out.append((seq, first[1] if now.get("moved") is None else now["last"], *now["p"], *now["v"], *now["q"], "INITIALIZED", None))
                    now["first"] = None
            p, v, q0 = now["p"], now["v"], now["q"]
            fall = GRAVITY * dt
            dp, dv = turn_vector(q0, (px, py, pz - fall * dt / 2)), turn_vector(q0, (vx, vy, vz - fall))
            new_p = (p[0] + v[0] * dt + dp[0], p[1] + v[1] * dt + dp[1], p[2] + v[2] * dt + dp[2] + fall * dt / 2)
            new_v = (v[0] + dv[0], v[1] + dv[1], v[2] + dv[2] + fall)
            new_q = unit_quaternion(multiply(q0, q))
            status = "DEGRADED_IMU_ONLY"
            if success:
                toward = turn_vector(q0, heading)
                moved = [a - b for a, b in zip(new_p, p)]
                along = sum(a * b for a, b in zip(moved, toward))
                if along > 0:
                    moved = [(1 - direction_weight) * a + direction_weight * along * b for a, b in zip(moved, toward)]
                new_q = slerp(new_q, multiply(q0, unit_quaternion(turn)), rotation_weight)
                gone = max((us - now["last"]) * 1e-6, 1e-4)
                new_p, new_v, status = tuple(a + b for a, b in zip(p, moved)), tuple(a / gone for a in moved), "TRACKING_OK"
            now |= {"p": new_p, "v": new_v, "q": new_q, "last": us, "moved": True}
            out.append((seq, us, *new_p, *new_v, *new_q, status, None))
        return now

    def run(batches):
        now, kinds = None, pa.schema([(c, pa.int64() if i < 2 else pa.string() if c in ("status", "state") else pa.float64()) for i, c in enumerate(names)])
        made = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.types)], names)
        for batch in batches:
            out = []
            now = steps(zip(*(c.to_pylist() for c in batch.columns), strict=True), now, out)
            yield made(out)
        if now is not None:
            ended(now, out := [])
            yield made(out)

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if start is None:
        rows = rows.withColumn("_past", F.lit(None).cast("string"))
    else:
        rows = rows.join(start.select("seq_id", F.col("state").alias("_past")), "seq_id", "left")
    moved = integrate(rows, "seq_id", "us", "success", "turn", "heading", "_past", totals=True)
    return moved.repartition(parts, "seq_id").sortWithinPartitions("seq_id", "us").mapInArrow(run, FUSED + ", state string")


def multiply(a, b):
    return (a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2], a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0])


def unit_quaternion(q):
    n = sum(x * x for x in q) ** 0.5
    return tuple(x / n for x in q)


def turn_vector(q, v):
    w, x, y, z = q
    a, b, c = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return (v[0] + w * a + y * c - z * b, v[1] + w * b + z * a - x * c, v[2] + w * c + x * b - y * a)


def slerp(a, b, t):
    return tuple(np_slerp(np.array(a), np.array(b), t).tolist())


POSE = ("px", "py", "pz", "qw", "qx", "qy", "qz")
KEYS = "seq_id long, us long, keyframe long"


def key_frames(rows: DataFrame, distance: float = 0.15, degrees: float = 5.0, interval: int = 15, little: float = 0.04, least: int = 15, start: DataFrame | None = None) -> DataFrame:
    """Greedy choice of key frames from rows (seq_id, us, px.., qw.., features), each against the last one
    chosen; keyframe numbers them. The first row is always one.

    Read in order of sequence and time with only the last choice carried along, so a task holds one batch.
    start (seq_id, seen, chosen, px.., qw..), as last_key_frames gives it, are states to go on from.
    """
    begun = ("seen", "chosen", *POSE)
    rows = rows.select("seq_id", "us", *POSE, "features")
    if start is None:
        rows = rows.withColumn("_start", F.lit(None).cast("struct<" + ", ".join(f"{c}: {'long' if i < 2 else 'double'}" for i, c in enumerate(begun)) + ">"))
    else:
        rows = rows.join(start.select("seq_id", F.struct(*begun).alias("_start")), "seq_id", "left")

    def run(batches):
        seq, seen, chosen, last = None, 0, 0, None
        for batch in batches:
            out = []
            for sid, us, px, py, pz, qw, qx, qy, qz, features, past in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sid != seq or last is None:
                    seq, seen, chosen, last = (sid, 0, 0, None) if past is None else (sid, past["seen"], past["chosen"], tuple(past[c] for c in POSE))
                seen += 1
                if last is not None:
                    moved = math.dist((px, py, pz), last[:3])
                    turned = math.degrees(2 * math.acos(min(1.0, abs(qw * last[3] + qx * last[4] + qy * last[5] + qz * last[6]))))
                    since = seen - (chosen - 1) * interval  # frames seen less interval * number of the last one
                    if not (moved >= distance or turned >= degrees or (since >= interval and moved >= little)) or features < least:
                        continue
                out.append((sid, us, chosen))
                chosen, last = chosen + 1, (px, py, pz, qw, qx, qy, qz)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["seq_id", "us", "keyframe"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("seq_id", "us", *POSE, "features", "_start").repartition(parts, "seq_id").sortWithinPartitions("seq_id", "us").mapInArrow(run, KEYS)


def last_key_frames(rows: DataFrame, chosen: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """seq_id, seen, chosen and the pose of the last key frame of each sequence, for key_frames to go on from;
    rows and chosen are what it read and gave, start what it started from."""
    seen = rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("seen"))
    last = chosen.groupBy("seq_id").agg((F.max("keyframe") + 1).alias("chosen"), F.max("us").alias("us")).join(rows.select("seq_id", "us", *POSE), ["seq_id", "us"]).drop("us")
    now = seen.join(last, "seq_id", "left")
    if start is None:
        return now
    both = now.join(start.select("seq_id", F.struct("seen", "chosen", *POSE).alias("_start")), "seq_id", "full")
    seen = F.coalesce("seen", F.lit(0)) + F.coalesce("_start.seen", F.lit(0))
    return both.select("seq_id", seen.alias("seen"), *(F.coalesce(c, f"_start.{c}").alias(c) for c in ("chosen", *POSE)))
