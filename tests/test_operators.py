"""Boundary semantics against brute force on small rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geometry as g
from wayline.operators import folds, joins, learning, mapping, metrics, validate


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("span", [3, 1000])
def test_interval_join_boundaries(spark, span):
    frames = table(spark, [(1, t) for t in (10, 20, 30, 30, 50)], "seq_id long, us long")
    rows = [(1, t, i) for i, t in enumerate((5, 10, 11, 20, 20, 21, 45, 50, 51))]
    out = joins.interval_join(frames, table(spark, rows, "seq_id long, us long, id long"), ["id"], span=span).orderBy("us").collect()
    assert [(r.us, r.start_us, [s.us for s in r.samples]) for r in out] == [(10, None, []), (20, 10, [11, 20, 20]), (30, 20, [21]), (50, 30, [45, 50])]
    none = joins.interval_join(frames.limit(0), table(spark, rows, "seq_id long, us long, id long"), ["id"])
    assert none.count() == 0
    late = joins.interval_join(frames, table(spark, rows[:1], "seq_id long, us long, id long"), ["id"], include_first=False)
    assert late.count() == 3 and all(not r.samples for r in late.collect())
    with pytest.raises(Exception, match="no sample"):
        joins.require_samples(late).collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    left = [(s, rng.randrange(60), i) for s in (1, 2) for i in range(25)]
    right = [(s, t) for s in (1, 2, 3) for t in rng.sample(range(60), 12)]
    got = joins.nearest_asof(table(spark, left, "seq_id long, us long, id long"), table(spark, right, "seq_id long, us long"), 4, span=7).collect()
    assert len(got) == len(left)
    for r in got:
        best = min((abs(t - r.us), -t) for s, t in right if s == r.seq_id)
        want = -best[1] if best[0] <= 4 else None
        assert (r.other.us if r.other else None) == want
    with pytest.raises(ValueError):
        joins.nearest_asof(table(spark, left, "seq_id long, us long, id long"), table(spark, right, "seq_id long, us long"), 0)


def test_one_long_sequence_takes_time_in_proportion(spark):
    """A recording of 36,820 samples at 200 Hz inside one span, and one of four times as many."""
    import time

    seconds = []
    for n in (36_820, 147_280):
        samples = spark.range(n).select(F.lit(1).alias("seq_id"), (F.col("id") * 5000).alias("us"), "id")
        frames = samples.where("id % 10 = 0").select("seq_id", "us")
        began = time.perf_counter()
        joined = joins.interval_join(frames, samples, ["id"]).select(F.sum(F.size("samples")), F.count("*")).first()
        near = joins.nearest_asof(samples, frames.withColumn("us", F.col("us") + 1), 30_000).select(F.sum("diff_us"), F.count("other.us")).first()
        tail = joins.ahead_or_last(samples, 1_000_000).count()
        seconds.append(time.perf_counter() - began)
        assert tuple(joined) == (n - 10, n / 10) and near[1] == n - 3 and tail == n - 180
    assert seconds[1] < 8 * seconds[0] and seconds[0] < 60


def test_nearest_points_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = [(1, f, i, float(u), float(v)) for f in (0, 1, 2) for i, (u, v) in enumerate(rng.uniform(-5, 5, (40, 2)))]
    got = joins.nearest_points(table(spark, pts, "seq_id long, frame long, idx long, u double, v double"), 1.0).collect()
    for r in got:
        near = [(math.hypot(u - r.u, v - r.v), i) for _, f, i, u, v in pts if f == r.frame - 1]
        best = min(near, default=(9, None))
        assert r.prev_idx == (best[1] if best[0] < 1.0 else None)


def test_ahead(spark):
    rows = table(spark, [(1, t) for t in (0, 10, 20, 35, 60)], "seq_id long, us long")
    assert {(r.us, r.ahead.us) for r in joins.ahead_in_time(rows, 10, 5).collect()} == {(0, 10), (10, 20)}
    assert {(r.us, r.ahead.us) for r in joins.ahead_or_last(rows, 25, 0.9).collect()} == {(0, 35), (10, 35), (20, 60), (35, 60)}


def test_health_windows_equal_the_machine(spark):
    rng = random.Random(9)
    rows = []
    for s in range(60):
        for t in range(40):
            rows.append((s, t, rng.random() > 0.01, rng.random() > 0.3, rng.random() > 0.45, rng.choice([5, 30, 30, 30])))
    got = {(r.seq_id, r.us): (r.state, r["count"]) for r in folds.health_states(table(spark, rows, "seq_id long, us long, valid boolean, ready boolean, visual boolean, features int"), 10, 4).collect()}
    for s in range(60):
        state, count = folds.INITIALIZING, 0
        for _, t, valid, ready, visual, features in (r for r in rows if r[0] == s):
            state, count = folds.health_step(state, count, valid, ready, visual, features, 10, 4)
            assert got[s, t] == (state, count)
    assert {x[0] for x in got.values()} == {"INITIALIZING", "TRACKING", "DEGRADED", "LOST"}


def test_inertial_fold(spark):
    rows = [(1, [(0, 2.0, 0.0, -9.81, 0.0, 0.0, 0.0), (1_000_000, 2.0, 0.0, -9.81, 0.0, 0.0, 0.0)]), (2, []), (3, [(0, 1.0, 0.0, -9.81, 0.0, 0.0, 0.0)]), (4, [(i * 5000, 0.3, -0.2, -9.7, 0.4, -0.1, 0.2) for i in range(9)])]
    df = table(spark, rows, "id long, samples array<struct<us: long, ax: double, ay: double, az: double, wx: double, wy: double, wz: double>>")
    got = {r.id: r for r in folds.integrate(df, "id").collect()}
    assert (round(got[1].px, 12), round(got[1].vx, 12), got[1].qw) == (1.0, 2.0, 1.0)
    assert (got[2].px, got[2].vx) == (0.0, 0.0) and abs(got[3].vx - 0.005) < 1e-12
    p, v, q = folds.advance(np.zeros(3), np.zeros(3), np.array([1.0, 0, 0, 0]), np.array(rows[3][1]))
    assert np.allclose([got[4].px, got[4].vz, got[4].qx, got[4].qz], [p[0], v[2], q[1], q[3]], atol=1e-12)


def test_quaternions(spark):
    h = math.sqrt(0.5)
    one = spark.range(1)
    get = lambda cols: [one.select(*(c.alias(str(i)) for i, c in enumerate(cols))).first()[i] for i in range(len(cols))]
    lit = lambda *x: tuple(F.lit(float(v)) for v in x)
    assert np.allclose(get(g.rotate(lit(h, 0, 0, h), lit(1, 0, 0))), [0, 1, 0])
    assert np.allclose(get(g.q_euler(lit(h, 0, 0, h))), [0, 0, 90])
    assert np.allclose(get(g.q_slerp(lit(1, 0, 0, 0), lit(-h, 0, 0, -h), 0.5)), [math.cos(math.pi / 8), 0, 0, math.sin(math.pi / 8)])
    for q in ((0.1, 0.9, 0.2, -0.3), (0.2, -0.1, 0.9, 0.3), (0.1, 0.2, 0.3, 0.9), (0.9, 0.1, 0.1, 0.2)):
        n = np.array(q) / np.linalg.norm(q)
        assert np.allclose(get(g.q_from_matrix(g.q_matrix(lit(*q)))), n)
    with pytest.raises(Exception, match="near zero"):
        get(g.q_normalize(lit(0, 0, 0, 0)))
    assert np.allclose(get(g.levelling(lit(0, 0, -9.81))), [1, 0, 0, 0])


@pytest.mark.parametrize("scale", [None, 2.25])
def test_alignment_recovers_a_transform(spark, scale):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    src = rng.uniform(-5, 5, (40, 3))
    dst = (scale or 1.0) * src @ q.T + [1, -2, 3]
    rows = table(spark, [(1, *map(float, a), *map(float, b)) for a, b in zip(src, dst)] + [(2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "seq_id long, px double, py double, pz double, tx double, ty double, tz double")
    fit = metrics.solve_alignment(metrics.alignment_moments(rows, ("px", "py", "pz"), ("tx", "ty", "tz"), ["seq_id"]), scale is not None, ["seq_id"])
    r = {x.seq_id: x for x in fit.collect()}
    assert np.allclose(np.array(r[1].r).reshape(3, 3), q, atol=1e-10) and np.allclose(r[1].t, [1, -2, 3]) and abs(r[1].scale - (scale or 1.0)) < 1e-10
    assert r[2].r is None
    moved = metrics.apply_alignment(rows.where("seq_id = 1"), fit, ("px", "py", "pz"), ["seq_id"])
    assert moved.select(F.max(g.norm(g.sub(g.vec("ax", "ay", "az"), g.vec("tx", "ty", "tz"))))).first()[0] < 1e-9


def test_fusion_and_key_frames(spark):
    still = [(i * 5000, 0.0, 0.0, -9.81, 0.0, 0.0, 0.0) for i in range(11)]
    rows = [(1, f * 50_000, [(f * 50_000 - 50_000 + s[0], *s[1:]) for s in still[1:]] if f else [], f % 2 == 1, [1.0, 0.0, 0.0, 0.001], [1.0, 0.0, 0.0]) for f in range(6)]
    kind = "seq_id long, us long, samples array<struct<us: long, ax: double, ay: double, az: double, wx: double, wy: double, wz: double>>, success boolean, turn array<double>, heading array<double>"
    out = folds.fuse(table(spark, rows, kind)).orderBy("us").collect()
    assert [r.status for r in out] == ["INITIALIZED"] + ["TRACKING_OK", "DEGRADED_IMU_ONLY"] * 2 + ["TRACKING_OK"]
    assert all(abs(r.px) + abs(r.vx) < 1e-9 and abs(r.qw**2 + r.qx**2 + r.qy**2 + r.qz**2 - 1) < 1e-12 for r in out) and out[5].qz > 0
    path = [(1, i, 0.05 * i, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 20 if i != 3 else 3) for i in range(8)]
    keys = folds.key_frames(table(spark, path, "seq_id long, us long, px double, py double, pz double, qw double, qx double, qy double, qz double, features int"))
    assert [(r.us, r.keyframe) for r in keys.orderBy("us").collect()] == [(0, 0), (4, 1), (7, 2)]


def test_fusion_equals_step_by_step(spark):
    """Against the plain fold over every sample, levelling and mixing included."""
    rng, rows, want = np.random.default_rng(12), [], []
    for seq in (1, 2, 3):
        p, v, q, last, early, levelled, mine = np.zeros(3), np.zeros(3), np.array([1.0, 0, 0, 0]), None, [], False, []
        for f in range(25):
            us = f * 60_000
            m = 0 if f == 0 else int(rng.integers(0, 6))
            xs = [(us - 60_000 + 10_000 * (i + 1), *map(float, rng.normal([0.4, -0.3, -9.7], 0.3)), *map(float, rng.normal(0, 0.4, 3))) for i in range(m)]
            ok, turn, heading = bool(f % 3), [1.0, *map(float, rng.normal(0, 0.02, 3))], [0.6, 0.0, 0.8]
            rows.append((seq, us, xs, ok, turn, heading))
            if last is not None:
                if not levelled:
                    early += [x[1:4] for x in xs]
                    if len(early) >= 5:
                        q, levelled = folds.level(np.mean(early, axis=0)), True
                        mine[0] = (last, p, v, q)
                n_p, n_v, n_q = folds.advance(p, v, q, np.array(xs).reshape(-1, 7))
                if ok:
                    toward, moved = folds.np_rotate(q, np.array(heading)), n_p - p
                    along = moved @ toward
                    moved = 0.5 * moved + 0.5 * along * toward if along > 0 else moved
                    n_q = folds.np_slerp(n_q, folds.np_product(q, folds.quat(turn)), 0.5)
                    n_p, n_v = p + moved, moved / 0.06
                p, v, q = n_p, n_v, n_q
            last = us
            mine.append((us, p, v, q))
        want += [(seq, u, *a, *b, *c) for u, a, b, c in mine]
    kind = "seq_id long, us long, samples array<struct<us: long, ax: double, ay: double, az: double, wx: double, wy: double, wz: double>>, success boolean, turn array<double>, heading array<double>"
    got = sorted(tuple(r)[:12] for r in folds.fuse(table(spark, rows, kind)).collect())
    assert len(got) == 75 and np.allclose(np.array(got), np.array(sorted(want)), atol=1e-9)


def test_validation_and_acceptance(spark):
    rows = table(spark, [(1, 0, 5), (1, 1, 5), (1, 2, -3), (1, 3, None), (1, 4, 9)], "seq_id long, n long, us long")
    strict = {r.n: r.reason for r in validate.order_violations(rows, True, tie="n").collect()}
    assert strict == {1: "not increasing", 2: "negative", 3: "missing"}
    with pytest.raises(ValueError, match="frames"):
        validate.enforce(validate.order_violations(rows, False, tie="n"), "frames")
    one = spark.range(1)
    judge = lambda *x: one.select(mapping.acceptance(*(F.lit(float(v)) for v in x[:5]), tuple(F.lit(float(v)) for v in (x[5], 0, 1)))).first()[0]
    assert judge(5, 2, 2, 0.5, 0.5, "nan") == "REJECTED_NUMERICAL"
    assert judge(0.5, -2, 2, 9, 9, 0) == "REJECTED_PARALLAX" and judge(5, -2, 2, 9, 9, 0) == "REJECTED_NEGATIVE_DEPTH"
    assert judge(5, 2, 60, 9, 9, 0) == "REJECTED_DEPTH_RANGE" and judge(5, 2, 2, 0.5, 2.5, 0) == "REJECTED_REPROJECTION" and judge(5, 2, 2, 2, 2, 0) == "SUCCESS"


def test_gate_and_training(spark):
    rows = table(spark, [(5.0, 0.1), (5.0, 0.2), (1.0, 0.35), (-9.0, 0.9), (float("inf"), 0.9)], "d double, c double")
    (x, _, _), c = learning.gate((F.col("d"), F.col("d"), F.col("d")), F.col("c"))
    got = [(round(r[0], 9), r[1]) for r in rows.select(x, c).collect()]
    assert got == [(0.0, 0.1), (0.0, 0.2), (0.5, 0.35), (-3.0, 0.9), (0.0, 0.0)]
    rng = np.random.default_rng(1)
    z = rng.normal(size=(600, 18))
    weights, losses = learning.train(z, np.stack([z[:, 0], z[:, 1] / 2, -z[:, 2]], axis=1), epochs=8)
    assert losses[-1] < 0.7 * losses[0] and weights["shared.0.weight"].shape == (32, 18)
    df = table(spark, [(0, z[0].tolist())], "id long, v array<double>")
    h = np.maximum(weights["shared.0.weight"] @ z[0] + weights["shared.0.bias"], 0)
    h = np.maximum(weights["shared.2.weight"] @ h + weights["shared.2.bias"], 0)
    want = weights["residual_head.weight"] @ h + weights["residual_head.bias"]
    assert np.allclose(list(learning.network(df, "v", weights).select("dvx", "dvy", "dvz").first()), want, atol=1e-9)


def test_training_on_all_rows_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(301, 18))
    y = np.stack([x[:, 0], x[:, 1] / 2, -x[:, 2]], axis=1)
    xs, ys = learning.FEATURES, ["r0", "r1", "r2"]
    rows = table(spark, np.hstack([x, y]).tolist(), ", ".join(f"{c} double" for c in xs + ys)).repartition(5)
    weights, losses = learning.train_rows(rows, xs, ys, epochs=4)
    p = {k: v.astype(float) for k, v in learning.seeded_weights().items()}
    adam, want = learning.Adam(p, 1e-2, 1e-4), []
    for _ in range(4):
        loss, grads = learning.gradients(p, x, y, len(x))
        want.append(loss)
        adam.step(grads)
    assert np.allclose(losses, want, rtol=1e-9) and all(np.allclose(weights[k], p[k], atol=1e-9) for k in p) and losses[-1] < losses[0]
    # the gradients themselves, by differences
    loss, grads = learning.gradients(p, x, y, len(x))
    for name, at in (("shared.0.weight", (3, 2)), ("shared.2.bias", (5,)), ("confidence_head.0.weight", (0, 1))):
        near = {k: v.copy() for k, v in p.items()}
        near[name][at] += 1e-6
        assert abs((learning.gradients(near, x, y, len(x))[0] - loss) / 1e-6 - grads[name][at]) < 1e-4
    assert learning.train_rows(rows.limit(0), xs, ys)[1] == []


def test_map_building_rejects_and_tries_again(spark):
    lens = {"fx": 410.0, "fy": 415.0, "cx": 300.0, "cy": 220.0}
    points = {1: (0.2, -0.1, 4.0), 2: (0.5, 0.3, 6.0), 3: (-0.4, 0.2, 5.0), 4: (0.1, 0.1, -4.0), 5: (0.0, 0.2, 80.0)}
    obs = []
    for track, (x, y, z) in points.items():
        for kf, c in enumerate((0.0, 0.01, 0.5, 1.0)):
            v = 415.0 * y / z + 220.0
            if track == 2 and kf == 2 or track == 3 and kf > 0:
                v += 40.0  # no point explains this pixel
            obs.append((track, kf, np.eye(3).reshape(-1).tolist(), [c, 0.0, 0.0], 410.0 * (x - c) / z + 300.0, v))
    obs.append((6, 0, np.eye(3).reshape(-1).tolist(), [0.0, 0.0, 0.0], 300.0, 220.0))
    rows = table(spark, obs, "track long, kf long, r array<double>, c array<double>, u double, v double")
    got = {r.track: r for r in mapping.build_map(rows, lens).collect()}
    assert {t: (r.kf, r.attempts) for t, r in got.items()} == {1: (2, 2), 2: (3, 3), 3: (None, 3), 4: (None, 3), 5: (None, 3)}
    assert np.allclose([(got[t].x, got[t].y, got[t].z) for t in (1, 2)], [points[1], points[2]], atol=1e-6)
    assert got[1].error < 1e-6 and abs(got[2].depth - 6.0) < 1e-6 and got[3].x is None
    assert mapping.build_map(rows.limit(0), lens).count() == 0


def test_evaluation_of_odd_sequences(spark):
    """A sequence in which one pair has no velocity has no velocity errors; one of a single pair has no alignment."""
    pose = lambda seq, us, x, vx: (seq, us, us, x, 0.0, 0.0, vx, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)
    kind = "seq_id long, us long, event_id long, px double, py double, pz double, vx double, vy double, vz double, qw double, qx double, qy double, qz double"
    est = table(spark, [pose(1, i, float(i), 1.0 if i else None) for i in range(4)] + [pose(2, 0, 1.0, 1.0)], kind)
    true = table(spark, [pose(1, i, i + 0.5, 1.0) for i in range(5)] + [pose(2, 0, 1.0, 3.0)], kind)
    names = dict(zip(metrics.POS + metrics.VEL + metrics.QUAT, metrics.TRUE_POS + metrics.TRUE_VEL + metrics.TRUE_QUAT, strict=True))
    both = est.join(true.select("seq_id", "us", F.col("event_id").alias("other_id"), *(F.col(c).alias(t) for c, t in names.items())), ["seq_id", "us"])
    got = {r.seq_id: r for r in metrics.evaluation(both, est, true, {"row": joins.ahead_by_rows(both, 1)}).collect()}
    assert (got[1].matched, got[1].unmatched_est, got[1].unmatched_true, got[1].velocity_mean, got[1].row_n) == (4, 0, 1, None, 3)
    assert abs(got[1].ate_rmse - 0.5) < 1e-12 and abs(got[1].rigid_rmse) < 1e-9 and got[1].length_ratio == 1.0
    assert got[2].velocity_mean == 2.0 and got[2].rigid_rmse is None and got[2].row_n is None and got[2].length_ratio == 1.0
