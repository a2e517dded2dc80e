import math
import random

import pytest
from pyspark.sql import functions as F

from wayline.llm import negatives
from wayline.llm.negatives import LONG, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, number int, slot int"


def brute(rows, positives=5, k=10, low=30, high=90):
    """All scores by plain integers."""
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, lab in ok:
        if a % 10:
            continue
        meet = [(max(-LONG, min(LONG, sum(x * y for x, y in zip(q, p, strict=True)))), i, own) for i, p, own in ok if i != a and len(p) == len(q)]
        for s, i, _ in sorted((m for m in meet if m[2] == lab), key=lambda m: (-m[0], m[1]))[:positives]:
            found = sorted((m for m in meet if m[2] != lab and low * s <= 100 * m[0] <= high * s), key=lambda m: (-m[0], m[1]))[:k]
            out += [(a, i, r + 1, m[1], s, m[0]) for r, m in enumerate(found)]
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    out = hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def random_rows(n, dim, seed, span=1.0):
    r = random.Random(seed)
    return [(i, [r.uniform(-0.2, 1) * span for _ in range(dim)], r.randrange(3)) for i in range(n)]


def test_equal_to_brute_force(spark):
    rows = random_rows(300, 8, 1)
    assert run(spark, rows) == brute(rows) != []


def test_many_blocks_and_small_products(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 400)
    monkeypatch.setattr(negatives, "CELLS", 64)
    rows = random_rows(120, 4, 2)
    assert run(spark, rows) == brute(rows)


def test_ties_and_a_very_common_vector(spark):
    rows = random_rows(60, 4, 3) + [(100 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = random_rows(60, 4, 4)
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (210, [1.0] * 4, None), (220, [1.0, None, 1.0, 1.0], 1), (230, [1.0, float("nan"), 1.0, 1.0], 1), (240, [1.0, float("inf"), 1.0, 1.0], 1)]
    rows += [(250, [], 1), (251, [], 1), (252, [], 2), (260, [0.5] * 3, 1), (261, [0.5] * 3, 1), (262, [0.4] * 3, 2)]
    rows += [(270, [-1.0] * 4, 0), (271, [1.0] * 4, 0)]  # a window of a negative score is empty
    assert run(spark, rows) == brute(rows)
    assert (260, 261, 1, 262, 128 * 128 * 3, 128 * 102 * 3) in run(spark, rows)


def test_repeated_rows_count_twice(spark):
    rows = random_rows(40, 4, 5)
    rows += rows[:15]
    assert run(spark, rows) == brute(rows)


def test_scores_past_double_precision_are_exact(spark):
    rows = [(i, [x * 3e5 + 0.1 for x in v], lab) for i, v, lab in random_rows(60, 4, 6)]
    rows += [(60, [1e12, 1.0, 0.0, 0.0], 0), (61, [1e6, 1.0, 0.0, 0.0], 0), (62, [3e5, 0.25, 0.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0), (2, [1.0], 1)], [(10, [1.0], 0), (2, [1.0], 1)]])
def test_empty_and_without_anchors_or_positives(spark, rows):
    assert run(spark, rows) == []
