"""Exact quantiles against numpy, with brackets that take many passes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators.order import quantiles, summarize

WANTED = {"low": ("x", 0.0), "median": ("x", 0.5), "p95": ("x", 0.95), "high": ("x", 1.0), "other": ("y", 0.37)}


def check(spark, rows, few, by=("g",)):
    df = spark.createDataFrame(rows, "g string, h int, x double, y double")
    got = {tuple(r[b] for b in by): r for r in quantiles(df, list(by), WANTED, few=few).collect()}
    groups = {}
    for g, h, x, y in rows:
        groups.setdefault(tuple({"g": g, "h": h}[b] for b in by), []).append((x, y))
    assert set(got) == set(groups) or not by
    for key, own in groups.items():
        for name, (c, p) in WANTED.items():
            xs = [v for v in (o[0 if c == "x" else 1] for o in own) if v is not None and np.isfinite(v)]
            want = float(np.quantile(xs, p)) if xs else None
            assert got[key][name] == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-300)), (key, name)


def rows_of(kind, n, seed=0):
    r = random.Random(seed)
    draw = {"even": lambda: r.uniform(-1, 1), "wide": lambda: r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300), "ties": lambda: float(r.randrange(3)), "one": lambda: 7.0, "near": lambda: 1e9 + r.randrange(50) * 2.0**-20}[kind]
    return [(r.choice(["a", "a", "a", None, "b"]), r.randrange(2), draw(), draw()) for _ in range(n)]


@pytest.mark.parametrize("kind", ["even", "wide", "ties", "one", "near"])
def test_equal_to_numpy(spark, kind):
    check(spark, rows_of(kind, 700), few=20)


def test_few_values_need_no_pass_and_groups_of_two_keys(spark):
    check(spark, rows_of("even", 300, 1), few=4096, by=("g", "h"))


def test_whole_table(spark):
    check(spark, rows_of("even", 300, 2), few=10, by=())
    empty = spark.createDataFrame([], "g string, h int, x double, y double")
    assert [tuple(r) for r in quantiles(empty, [], WANTED).collect()] == [(None,) * 5]
    assert quantiles(empty, ["g"], WANTED).collect() == []


def test_odd_values_take_no_part(spark):
    rows = [("a", 0, None, 1.0), ("a", 0, float("nan"), 2.0), ("a", 0, float("inf"), None), ("a", 0, 3.0, None), ("b", 0, None, None), ("c", 0, -1.7e308, 1.0), ("c", 0, 1.7e308, 2.0), ("c", 0, 5.0, 2.0)]
    check(spark, rows, few=1)


def test_summary_joins_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 2.0)], "g string, x double")
    out = summarize(df, ["g"], [F.count("*").alias("n")], {"median": ("x", 0.5)})
    assert {r.g: (r.n, r.median) for r in out.collect()} == {None: (2, 2.5), "a": (1, 2.0)}


def test_bins_of_a_large_group_stay_few(spark):
    df = spark.range(300_000).select((F.col("id") * 0.5).alias("x"), F.lit("g").alias("g"))
    assert quantiles(df, ["g"], {"m": ("x", 0.25)}).first().m == 299_999 * 0.5 * 0.25
