"""Inertial steps combined in trees, and folds that go on from saved states."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import folds, inertial

SAMPLES = "seq_id long, end_us long, us long, ax double, ay double, az double, wx double, wy double, wz double"


def drawn(lengths, seed=0, rate=5_000):
    r, out, at = random.Random(seed), [], 0
    for i, n in enumerate(lengths):
        for _ in range(n):
            at += r.randrange(1, 2 * rate)
            out.append((i % 2, i, at, *(r.gauss(0, 2) for _ in range(2)), r.gauss(-9.81, 1), *(r.gauss(0, 0.5) for _ in range(3))))
    return out


def folded(rows, start=None):
    """One sample after another, in plain numpy."""
    out = {}
    for key in {r[:2] for r in rows}:
        state = start.get(key) if start else None
        p, v, q = (np.array(state[:3]), np.array(state[3:6]), np.array(state[6:])) if state is not None else (np.zeros(3), np.zeros(3), np.array([1.0, 0, 0, 0]))
        out[key] = np.concatenate(folds.advance(p, v, q, np.array(sorted(r[2:] for r in rows if r[:2] == key))))
    return out


def states(df):
    return {(r.seq_id, r.end_us): np.array([r[c] for c in inertial.STATE]) for r in df.collect()}


def close(got, want, tolerance=1e-9):
    assert set(got) == set(want)
    for k in want:
        assert np.abs(got[k] - want[k]).max() <= tolerance * max(1.0, np.abs(want[k]).max()), k


@pytest.mark.parametrize("span", [3_000, 100_000, 10**9])
def test_rows_equal_the_fold(spark, span):
    rows = drawn([1, 2, 3, 40, 7, 1, 200])
    df = spark.createDataFrame(rows, SAMPLES).repartition(5)
    close(states(inertial.integrate_rows(df, ["seq_id", "end_us"], span)), folded(rows))


def test_semigroup_is_associative():
    r = np.random.default_rng(0)
    a, b, c = (inertial.steps(r.normal(size=(50, 3)), r.normal(size=(50, 3)), r.uniform(0, 1, 50)) for _ in range(3))
    left, right = inertial.compose(inertial.compose(a, b), c), inertial.compose(a, inertial.compose(b, c))
    assert np.abs(left - right).max() < 1e-12
    assert np.abs(inertial.compose(inertial.identity(50), a) - a).max() < 1e-15 and np.abs(inertial.compose(a, inertial.identity(50)) - a).max() < 1e-15


def test_nested_samples_equal_rows(spark):
    rows = drawn([1, 5, 30, 2], 3)
    df = spark.createDataFrame(rows, SAMPLES)
    nested = df.groupBy("seq_id", "end_us").agg(F.array_sort(F.collect_list(F.struct("us", *inertial.SAMPLE))).alias("samples"))
    close(states(folds.integrate(nested, "seq_id", "end_us")), folded(rows))


def test_goes_on_from_a_state(spark):
    rows = drawn([61], 4)
    first, second = spark.createDataFrame(rows[:30], SAMPLES), spark.createDataFrame(rows[29:], SAMPLES)
    done = inertial.integrate_rows(first, ["seq_id", "end_us"], 50_000)
    close(states(inertial.integrate_rows(second, ["seq_id", "end_us"], 50_000, start=done)), folded(rows))
    close(states(inertial.integrate_rows(second, ["seq_id", "end_us"], 50_000, start=done.where("false"))), folded(rows[29:]))
    assert inertial.integrate_rows(first.where("false"), ["seq_id", "end_us"]).collect() == []


def test_one_long_interval_is_spread(spark):
    n, span, parts = 200_000, 2_000, 20
    # a turn at a constant rate about the vertical, and a constant pull ahead: known in closed form for no turn
    rows = spark.range(n).select(F.lit(0).cast("long").alias("seq_id"), F.lit(0).cast("long").alias("end_us"), F.col("id").alias("us"), F.lit(0.5).alias("ax"), F.lit(0.0).alias("ay"), F.lit(-9.81).alias("az"), *(F.lit(0.0).alias(c) for c in ("wx", "wy", "wz")))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = states(inertial.integrate_rows(rows, ["seq_id", "end_us"], span))[0, 0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    t = (n - 1) * 1e-6
    assert got == pytest.approx([0.25 * t * t, 0, 0, 0.5 * t, 0, 0, 1, 0, 0, 0], abs=1e-9)


POSES = "seq_id long, us long, px double, py double, pz double, qw double, qx double, qy double, qz double, features int"


def test_key_frames_go_on_from_their_last(spark):
    r, rows = random.Random(1), []
    for seq in (1, 2, 3):
        x = 0.0
        for us in range(60):
            x += r.choice([0, 0.01, 0.1])
            q = np.array([1.0, 0, 0, r.uniform(-0.05, 0.05)])
            q /= np.linalg.norm(q)
            rows.append((seq, us, x, 0.0, 0.0, *q.tolist(), r.choice([5, 30, 30])))
    df = spark.createDataFrame(rows, POSES)
    whole = sorted(map(tuple, folds.key_frames(df).collect()))
    cut = F.col("us") < F.when(F.col("seq_id") == 3, 0).otherwise(25)
    parts, start = [], None
    for piece in (df.where(cut), df.where(~cut & (F.col("us") < 40)), df.where(~cut & (F.col("us") >= 40))):
        chosen = folds.key_frames(piece, start=start)
        parts += map(tuple, chosen.collect())
        start = folds.last_key_frames(piece, chosen, start)
    assert sorted(parts) == whole and len(whole) > 10


def fusion_rows(spark, seed=2, n=40):
    r, rows = random.Random(seed), []
    for seq in (1, 2):
        at = 0
        for us in range(n):
            samples = []
            for _ in range(r.randrange(4)):
                at += 5000
                samples.append((at, r.gauss(0, 1), r.gauss(0, 1), r.gauss(-9.81, 0.3), *(r.gauss(0, 0.2) for _ in range(3))))
            h = np.array([r.gauss(1, 0.1), r.gauss(0, 0.1), 0.0])
            rows.append((seq, us * 20_000, samples, r.random() > 0.3, [1.0, 0.0, 0.0, r.uniform(-0.02, 0.02)], (h / np.linalg.norm(h)).tolist()))
    inner = "array<struct<us: long, " + ", ".join(f"{c}: double" for c in inertial.SAMPLE) + ">>"
    return spark.createDataFrame(rows, f"seq_id long, us long, samples {inner}, success boolean, turn array<double>, heading array<double>")


@pytest.mark.parametrize("cut", [1, 2, 17])
def test_fusion_in_two_halves_equals_one_run(spark, cut):
    rows = fusion_rows(spark)
    names = ["seq_id", "us", *inertial.STATE, "status"]
    whole = sorted(map(tuple, folds.fuse(rows).select(*names).collect()))
    first, second = rows.where(F.col("us") < cut * 20_000), rows.where(F.col("us") >= cut * 20_000)
    done = folds.fuse_on(first, None, hold=True)
    later = folds.fuse_on(second, folds.fusion_ends(done))
    halves = sorted(map(tuple, done.unionByName(later).where("status <> 'STATE'").select(*names).collect()))
    assert halves == whole  # to the last bit
    # without a state a sequence is reset
    reset = folds.fuse_on(second, folds.fusion_ends(done).where("seq_id = 1")).where("status <> 'STATE'")
    anew = {tuple(r) for r in folds.fuse(second).select(*names).collect() if r.seq_id == 2}
    assert {tuple(r) for r in reset.select(*names).collect() if r.seq_id == 2} == anew
