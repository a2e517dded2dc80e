"""Spaced points against the sequential rule."""

import random

import pytest

from wayline.operators.points import strongest_points

SCHEMA = "seq_id long, frame long, idx long, u double, v double, strength double"


def rule(rows, distance, most=None):
    out = []
    for frame in {r[:2] for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r[:2] == frame), key=lambda r: (-r[5], r[2])):
            if all((r[3] - t[3]) ** 2 + (r[4] - t[4]) ** 2 >= distance**2 for t in taken):
                taken.append(r)
        out += [(*r, i + 1) for i, r in enumerate(taken[:most])]
    return sorted(out)


def run(spark, rows, distance, most=None):
    return sorted(map(tuple, strongest_points(spark.createDataFrame(rows, SCHEMA), distance, most).collect()))


def drawn(n, seed, strength):
    r = random.Random(seed)
    return [(r.randrange(2), r.randrange(2), i, r.uniform(-50, 50), r.uniform(0, 40), float(strength(r, i))) for i in range(n)]


@pytest.mark.parametrize(("strength", "distance", "most"), [(lambda r, i: r.random(), 9.0, None), (lambda r, i: r.randrange(3), 6.5, 5), (lambda r, i: i, 25.0, None)])
def test_equals_the_sequential_rule(spark, strength, distance, most):
    rows = drawn(250, 1, strength)
    assert run(spark, rows, distance, most) == rule(rows, distance, most)


def test_dense_places_and_exact_distances(spark):
    rows = [(0, 0, i, 1.0, 1.0, float(i % 7)) for i in range(400)]
    rows += [(0, 0, 1000 + i, 10.0 * (i % 5), 10.0 * (i // 5), 3.0) for i in range(25)]  # a grid at the very distance
    assert run(spark, rows, 10.0) == rule(rows, 10.0)


def test_odd_points(spark):
    rows = [(0, 0, 1, 1.0, 1.0, 5.0), (0, 0, 2, None, 1.0, 9.0), (0, 0, 3, float("nan"), 1.0, 9.0), (0, 0, 4, 1.0, 1.0, None), (0, 0, None, 90.0, 1.0, 1.0), (None, 0, 5, 1.0, 1.0, 9.0)]
    assert run(spark, rows, 5.0) == [(0, 0, 1, 1.0, 1.0, 5.0, 1)]
    assert run(spark, [], 5.0) == []
    with pytest.raises(ValueError):
        run(spark, rows, 0.0)
