"""Motion from point pairs: planted motions with outliers and noise, counts from the chosen matrix, odd frames."""

import numpy as np
import pytest

from wayline.operators import consensus

LENS = {"fx": 500.0, "fy": 480.0, "cx": 320.0, "cy": 240.0}
SCHEMA = "seq_id long, frame long, idx long, u0 double, v0 double, u1 double, v1 double"


def rotation(axis, angle):
    x, y, z = axis = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def planted(frame, n, share, noise, seed):
    """Pairs of a frame with a share of outliers, and the motion."""
    r = np.random.default_rng(seed)
    points = r.uniform((-3, -2, 4), (3, 2, 12), (n, 3))
    turn, t = rotation(r.normal(size=3), 0.08), r.normal(size=3)
    t /= np.linalg.norm(t)
    there = points @ turn.T + t * 0.6
    f, c = np.array([LENS["fx"], LENS["fy"]]), np.array([LENS["cx"], LENS["cy"]])
    a, b = points[:, :2] / points[:, 2:] * f + c, there[:, :2] / there[:, 2:] * f + c
    a, b = a + r.normal(size=a.shape) * noise, b + r.normal(size=b.shape) * noise
    out = r.random(n) < share
    b[out] = r.uniform((0, 0), (640, 480), (out.sum(), 2))
    return [(frame % 2, frame, i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(a, b, strict=True))], turn, t


def near(e, rows, threshold=1.0):
    """Pairs within the threshold of a matrix, by numpy."""
    e, x = np.asarray(e).reshape(3, 3), np.array([r[3:] for r in rows])
    one = np.ones((len(x), 1))
    f, c = np.array([LENS["fx"], LENS["fy"]]), np.array([LENS["cx"], LENS["cy"]])
    a, b = np.hstack([(x[:, :2] - c) / f, one]), np.hstack([(x[:, 2:] - c) / f, one])
    ea, eb = a @ e.T, b @ e
    error = (b * ea).sum(1) ** 2 / (ea[:, 0] ** 2 + ea[:, 1] ** 2 + eb[:, 0] ** 2 + eb[:, 1] ** 2)
    return int((error <= (threshold / 490.0) ** 2).sum())


def angle(a, b):
    return np.degrees(np.arccos(np.clip((np.trace(a.T @ b) - 1) / 2, -1, 1)))


@pytest.mark.parametrize("lot", [1 << 20, 100])
def test_planted_motions(spark, monkeypatch, lot):
    """Also with frames dealt to lots of a hundred pairs."""
    monkeypatch.setattr(consensus, "LOT", lot)
    made = {f: planted(f, 150 + 130 * f, 0.3, 0.15 if f % 2 else 0.0, f) for f in range(6)}
    rows = [r for m in made.values() for r in m[0]]
    out = {r["frame"]: r for r in consensus.relative_motion(spark.createDataFrame(rows, SCHEMA).repartition(5), **LENS, least=20).collect()}
    assert sorted(out) == sorted(made)
    for f, (pairs, turn, t) in made.items():
        r, noisy = out[f], f % 2
        assert r["success"] and r["status"] == "ok" and r["tracked"] == len(pairs)
        assert r["inliers"] == near(r["e"], pairs) >= 0.65 * len(pairs)
        assert r["front"] >= 0.95 * r["inliers"]
        got = np.array(r["r"]).reshape(3, 3)
        assert np.allclose(got @ got.T, np.eye(3)) and np.isclose(np.linalg.det(got), 1)
        assert angle(got, turn) < (0.3 if noisy else 0.1)
        assert np.degrees(np.arccos(min(1.0, np.dot(r["t"], t)))) < (3.0 if noisy else 1.0)


@pytest.mark.parametrize("frame", [1, 3, 5])
def test_proposals_hold_for_any_draw(frame):
    """With noise, some proposal has most of its pairs whichever samples are drawn."""
    pairs, *_ = planted(frame, 150 + 130 * frame, 0.3, 0.15, frame)
    points = (np.array([r[3:] for r in pairs]) - [LENS["cx"], LENS["cy"]] * 2) / ([LENS["fx"], LENS["fy"]] * 2)
    for seed in range(10):
        found = consensus.hypotheses(points[:512], 256, 8, (1.0 / 490.0) ** 2, seed)
        assert found.shape == (8, 3, 3) and max(near(e, pairs) for e in found) >= 0.65 * len(pairs)


def test_odd_frames(spark):
    good = planted(0, 60, 0.0, 0.0, 7)[0]
    rows = list(good)
    rows += [(0, 1, *r[2:]) for r in good[:12]]
    rows += [(0, 2, *r[2:]) for r in good] + [(0, 2, 99, None, 1.0, 2.0, 3.0)]
    rows += [(0, 3, *r[2:]) for r in good] + [(0, 3, 99, 1.0, 1.0, float("inf"), 3.0)]
    rows += [(0, 4, r[2], r[3], 7.0, r[5], r[6]) for r in good]
    rows += [(None, 5, *r[2:]) for r in good]
    rows += [(0, 6, *r[2:5], float(i * 37 % 640), float(i * 101 % 480)) for i, r in enumerate(good)]
    rows += [(0, 8, *r[2:]) for r in good] * 2  # repeated rows count twice
    out = {r["frame"]: r for r in consensus.relative_motion(spark.createDataFrame(rows, SCHEMA), **LENS, least=40).collect()}
    status = {f: r["status"] for f, r in out.items()}
    assert status == {0: "ok", 1: "insufficient", 2: "non-finite", 3: "non-finite", 4: "degenerate", 6: "few inliers", 8: "ok"}
    assert all((r["r"] is None) == (r["e"] is None) == (not r["success"]) for r in out.values())
    assert (out[0]["inliers"], out[8]["inliers"]) == (60, 120)
    assert 0 < out[6]["inliers"] < 40 and out[1]["inliers"] == 0


def test_empty_table_and_arguments(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert consensus.relative_motion(empty, **LENS).collect() == []
    with pytest.raises(ValueError):
        consensus.relative_motion(empty, **LENS, least=5)
