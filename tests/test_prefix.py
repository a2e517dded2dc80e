"""Scans over spans against plain folds, and a sequence that no task holds as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import folds, joins, learning, metrics, prefix

SPANS = [3, 50, 10_000]


def drawn(n, seed=0, sequences=3):
    r = random.Random(seed)
    return [(r.randrange(sequences), us, r.choice([None, *range(-5, 6)])) for us in r.sample(range(-n, 3 * n), n)]


@pytest.mark.parametrize("span", SPANS)
def test_scans_equal_a_fold(spark, span):
    rows = drawn(200)
    df = spark.createDataFrame(rows, "seq_id long, us long, x long")
    x, hit = F.col("x"), F.col("x") > 0
    out = prefix.scan(
        df,
        span,
        s=prefix.running_sum(x),
        n=prefix.running_count(),
        nx=prefix.running_count(x),
        m=prefix.running_max(x),
        first=prefix.first_value(x),
        everything=prefix.total(x),
        before=prefix.neighbour(x),
        after=prefix.neighbour(x, forward=True),
        last_hit=prefix.nearest(F.col("us"), hit),
        next_hit=prefix.nearest(F.col("us"), hit, forward=True),
        strictly=prefix.nearest(F.col("us"), hit, strict=True),
    )
    assert out.columns[:3] == ["seq_id", "us", "x"] and "_span" not in out.columns
    want = {}
    for seq in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == seq)
        some = lambda f, xs: f(xs) if xs else None
        for i, (us, value) in enumerate(own):
            seen = [v for _, v in own[: i + 1] if v is not None]
            hits = [u for u, v in own if v is not None and v > 0]
            want[seq, us] = {
                "x": value,
                "s": some(sum, seen),
                "n": i + 1,
                "nx": len(seen),
                "m": some(max, seen),
                "first": own[0][1],
                "everything": some(sum, [v for _, v in own if v is not None]),
                "before": own[i - 1][1] if i else None,
                "after": own[i + 1][1] if i + 1 < len(own) else None,
                "last_hit": max((u for u in hits if u <= us), default=None),
                "next_hit": min((u for u in hits if u >= us), default=None),
                "strictly": max((u for u in hits if u < us), default=None),
            }
    assert {(r.seq_id, r.us): {k: r[k] for k in next(iter(want.values()))} for r in out.collect()} == want


def test_null_times_come_first_and_null_sequences_take_no_part(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 7, 1), (None, 3, 9)], "seq_id long, us long, x long")
    out = prefix.scan(df, 10, s=prefix.running_sum(F.col("x"))).collect()
    assert sorted((r.us is None, r.s) for r in out) == [(False, 6), (True, 5)]
    assert prefix.scan(df.where("x > 100"), 10, n=prefix.running_count()).collect() == []


@pytest.mark.parametrize("span", SPANS)
def test_what_stands_on_scans(spark, span):
    rows = [(s, us, float(x or 0)) for s, us, x in drawn(120, 3)]
    df = spark.createDataFrame(rows, "seq_id long, us long, x double").withColumns({"y": F.col("x") * 2, "z": F.lit(0.0)})
    by = {s: sorted(r[1:] for r in rows if r[0] == s) for s in {r[0] for r in rows}}
    ahead = {(r.seq_id, r.us): r.ahead.us for r in joins.ahead_by_rows(df, 4, span).collect()}
    assert ahead == {(s, own[i][0]): own[i + 4][0] for s, own in by.items() for i in range(len(own) - 4)}
    parts = {(r.seq_id, r.us): r.part for r in learning.chronological(df, 0.7, span).collect()}
    assert parts == {(s, own[i][0]): "train" if i + 1 <= int(len(own) * 0.7) else "test" for s, own in by.items() for i in range(len(own))}
    steps = {(r.seq_id, r.us): (r.prev_us, r.dt) for r in learning.with_steps(df, span).collect()}
    assert steps == {(s, own[i][0]): (own[i - 1][0], max((own[i][0] - own[i - 1][0]) * 1e-6, 1e-4)) if i else (None, 0.05) for s, own in by.items() for i in range(len(own))}
    length = {r.seq_id: r.length for r in metrics.path_length(df, ("x", "y", "z"), span=span).collect()}
    assert length == pytest.approx({s: sum(abs(b[1] - a[1]) * 5**0.5 for a, b in zip(own, own[1:], strict=False)) for s, own in by.items()})


def health_rows(n, seed):
    r = random.Random(seed)
    # no more than a few invalid rows, so that most runs go on; long bad runs cross spans
    bad, rows = 0, []
    for us in range(n):
        bad = bad - 1 if bad > 0 else r.choice([0, 0, 0, 0, r.randrange(9)])
        rows.append((r.randrange(3) if seed % 2 else 0, us, r.random() > 0.01, r.random() > 0.5, bad == 0, r.choice([5, 30, 30, 30])))
    return rows


HEALTH = "seq_id long, us long, valid boolean, ready boolean, visual boolean, features int"


def fold(rows, least, timeout, start=None):
    now, out = dict(start or {}), {}
    for seq, us, *given in sorted(rows, key=lambda r: r[1]):
        now[seq] = out[seq, us] = folds.health_step(*now.get(seq, (folds.INITIALIZING, 0)), *given, least, timeout)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("span", [1, 4, 30, 1000])
def test_health_maps_equal_the_machine(spark, seed, span):
    rows = health_rows(150, seed)
    out = folds.health_states(spark.createDataFrame(rows, HEALTH), 10, 6, span)
    assert {(r.seq_id, r.us): (r.state, r["count"]) for r in out.collect()} == fold(rows, 10, 6)


def test_health_goes_on_from_its_last_states(spark):
    rows = health_rows(120, 2)
    first, second = [r for r in rows if r[1] < 57], [r for r in rows if r[1] >= 57]
    done = folds.health_states(spark.createDataFrame(first, HEALTH), 10, 6, 9)
    later = folds.health_states(spark.createDataFrame(second, HEALTH), 10, 6, 9, start=folds.last_health(done))
    assert {(r.seq_id, r.us): (r.state, r["count"]) for r in done.unionByName(later).collect()} == fold(rows, 10, 6)
    anew = folds.health_states(spark.createDataFrame(second, HEALTH), 10, 6, 9, start=folds.last_health(done).where("false"))
    assert {(r.seq_id, r.us): (r.state, r["count"]) for r in anew.collect()} == fold(second, 10, 6)


def test_one_long_sequence_is_spread(spark):
    n, span, parts = 400_000, 5_000, 40
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(n).select(F.lit(1).alias("seq_id"), F.col("id").alias("us"), (F.col("id") % 7).alias("x"))
        out = prefix.scan(rows, span, s=prefix.running_sum(F.col("x")), before=prefix.neighbour(F.col("x")))
        tasks = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("s").alias("s")).collect()
        assert sum(t.n for t in tasks) == n and max(t.n for t in tasks) <= 6 * span and len(tasks) > parts / 2
        assert out.orderBy(F.desc("us")).first().s == sum(i % 7 for i in range(n))
        flags = rows.select("seq_id", "us", F.lit(True).alias("valid"), F.lit(True).alias("ready"), (F.col("us") % 1000 > 40).alias("visual"), F.lit(30).alias("features"))
        states = folds.health_states(flags, 10, 50, span)
        tasks = states.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("state")).collect()
        assert sum(t.n for t in tasks) == n and max(t.n for t in tasks) <= 6 * span
        assert {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()} == {"TRACKING": n - n // 1000 * 41 + 1, "DEGRADED": n // 1000 * 41 - 1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
