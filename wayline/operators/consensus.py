"""Motion between two views from point pairs with outliers: hypotheses, votes of all pairs, pose by depth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import finite
from .tables import saved

FRAME = ["seq_id", "frame"]
POINT = ["x0", "y0", "x1", "y1"]
#: Pairs of one frame that vote in one task.
LOT = 1 << 20
#: The monomials x1[i] * x0[j] that an essential matrix weighs, in its order by rows.
MONOMIALS = [(i, j) for i in range(3) for j in range(3)]
UPPER = [(a, b) for a in range(9) for b in range(a, 9)]


def essential(e: np.ndarray) -> np.ndarray:
    """The nearest matrices with singular values 1, 1, 0 (up to scale) for a stack of 3x3 matrices."""
    u, _, vt = np.linalg.svd(e)
    return u[..., :, :2] @ vt[..., :2, :]


def scaling(mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What takes points of both views (x0, y0, x1, y1) to mean 0 and spread 1, as 3x3 matrices."""
    out = []
    for m, s in ((mean[:2], spread[:2]), (mean[2:], spread[2:])):
        out.append(np.array([[1 / s[0], 0, -m[0] / s[0]], [0, 1 / s[1], -m[1] / s[1]], [0, 0, 1]]))
    return out[0], out[1]


def hypotheses(points: np.ndarray, tries: int, keep: int, limit: float, seed: int) -> np.ndarray:
    """The `keep` best of `tries` eight-point solutions from samples of points (n, 4), by cost on them; each is fitted
    again to the points within the limit for as long as that lowers its cost, as eight noisy points alone may miss
    most of those that they belong to."""
    n = len(points)
    spread = np.maximum(points.std(axis=0), 1e-12)
    t0, t1 = scaling(points.mean(axis=0), spread)
    one = np.ones((n, 1))
    a, b = np.hstack([points[:, :2], one]), np.hstack([points[:, 2:], one])
    rows = np.einsum("ni,nj->nij", b @ t1.T, a @ t0.T).reshape(n, 9)

    def errors(e: np.ndarray) -> np.ndarray:
        ea, eb = np.einsum("hij,nj->hni", e, a), np.einsum("hji,nj->hni", e, b)
        size = ea[..., 0] ** 2 + ea[..., 1] ** 2 + eb[..., 0] ** 2 + eb[..., 1] ** 2
        return np.einsum("hni,ni->hn", ea, b) ** 2 / np.maximum(size, 1e-300)

    chosen = np.argsort(np.random.default_rng(seed).random((tries, n)), axis=1)[:, :8]
    _, _, vt = np.linalg.svd(rows[chosen])
    e = essential(t1.T @ vt[:, 8].reshape(-1, 3, 3) @ t0)
    error = errors(e)
    cost = np.minimum(error, limit).sum(axis=1)
    best = np.argsort(cost, kind="stable")[np.arange(keep) % tries]
    e, error, cost = e[best], error[best], cost[best]
    better = np.ones(keep, bool)
    while better.any():
        square = np.stack([rows[x].T @ rows[x] for x in error <= limit])
        fitted = essential(t1.T @ np.linalg.eigh(square)[1][..., 0].reshape(-1, 3, 3) @ t0)
        new = errors(fitted)
        less = np.minimum(new, limit).sum(axis=1)
        better = less < cost - 1e-6 * limit
        e[better], error[better], cost[better] = fitted[better], new[better], less[better]
    return e


def poses(e: np.ndarray) -> np.ndarray:
    """The four motions (nine of the rotation by rows, three of the direction) of a stack of matrices."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u))[..., None, None], vt * np.sign(np.linalg.det(vt))[..., None, None]
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    turns, t = (u @ w @ vt, u @ w.T @ vt), u[..., :, 2]
    flat = [np.concatenate([r.reshape(*t.shape[:-1], 9), s * t], axis=-1) for r in turns for s in (1, -1)]
    return np.stack(flat, axis=-2)


def with_errors(rows: DataFrame, n: int) -> DataFrame:
    """Adds err0, ..: squared distance of a pair from its epipolar lines to first order, for each of n matrices in e."""
    lines = []
    for k in range(n):
        at = lambda i, j, k=k: f"e[{9 * k + 3 * i + j}]"
        lines += [f"{at(i, 0)} * x0 + {at(i, 1)} * y0 + {at(i, 2)} AS a{k}_{i}" for i in range(3)]
        lines += [f"{at(0, j)} * x1 + {at(1, j)} * y1 + {at(2, j)} AS b{k}_{j}" for j in range(2)]
    sizes = [f"a{k}_0 * a{k}_0 + a{k}_1 * a{k}_1 + b{k}_0 * b{k}_0 + b{k}_1 * b{k}_1 AS size{k}" for k in range(n)]
    offs = [f"x1 * a{k}_0 + y1 * a{k}_1 + a{k}_2 AS off{k}" for k in range(n)]
    errors = [f"CASE WHEN size{k} > 0 THEN off{k} * off{k} / size{k} ELSE double('inf') END AS err{k}" for k in range(n)]
    return rows.selectExpr("*", *lines).selectExpr(*rows.columns, *sizes, *offs).selectExpr(*rows.columns, *errors)


def with_depths(rows: DataFrame, n: int) -> DataFrame:
    """Adds, for each of n motions in p, near0, .. and far0, .., the depths in both views times size0, .. (not negative)."""
    turned = [f"p[{12 * m + 3 * i}] * x0 + p[{12 * m + 3 * i + 1}] * y0 + p[{12 * m + 3 * i + 2}] AS r{m}_{i}" for m in range(n) for i in range(3)]
    dots = []
    for m in range(n):
        t = [f"p[{12 * m + 9 + i}]" for i in range(3)]
        dots += [f"r{m}_0 * r{m}_0 + r{m}_1 * r{m}_1 + r{m}_2 * r{m}_2 AS rr{m}", f"r{m}_0 * x1 + r{m}_1 * y1 + r{m}_2 AS rb{m}"]
        dots += [f"{t[0]} * r{m}_0 + {t[1]} * r{m}_1 + {t[2]} * r{m}_2 AS tr{m}", f"{t[0]} * x1 + {t[1]} * y1 + {t[2]} AS tb{m}"]
    # least squares of depth0 * r + t = depth1 * b
    depths = [e for m in range(n) for e in (f"rb{m} * tb{m} - bb * tr{m} AS near{m}", f"rr{m} * tb{m} - rb{m} * tr{m} AS far{m}", f"rr{m} * bb - rb{m} * rb{m} AS size{m}")]
    return rows.selectExpr("*", *turned).selectExpr(*rows.columns, "x1 * x1 + y1 * y1 + 1 AS bb", *dots).selectExpr(*rows.columns, *depths)


def voting(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows with their frame's candidates (a saved table, so that its size is known); a frame of many rows is dealt
    to as many lots as it has."""
    return rows.join(candidates.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))), [*FRAME, "lot"])


def elected(rows: DataFrame, candidates: DataFrame, n: int, limit: float, far: float | None = None) -> DataFrame:
    """Per frame the candidate (of n in `e`) with most pairs within the limit, then the least cost, then the first.

    With `far`, `p` has the four motions of each, and the motion is chosen under which most of these pairs lie in
    front of both views, at most `far` baselines away.
    """
    told = with_errors(voting(rows, candidates), n)
    sums = [e for k in range(n) for e in (f"count_if(err{k} <= {limit!r}D) AS n{k}", f"sum(least(err{k}, {limit!r}D)) AS c{k}")]
    pose = lambda k: ""
    if far is not None:
        told = with_depths(told, 4 * n)
        within = lambda c, m: f"{c}{m} > 0 AND {c}{m} < {float(far)!r}D * size{m}"
        sums += [f"count_if(err{m // 4} <= {limit!r}D AND {within('near', m)} AND {within('far', m)}) AS f{m}" for m in range(4 * n)]
        pose = lambda k: ", 'pose', array_max(array(" + ", ".join(f"named_struct('front', f{4 * k + m}, 'rank', {-m})" for m in range(4)) + "))"
    options = ", ".join(f"named_struct('votes', n{k}, 'gain', -c{k}, 'rank', {-k}{pose(k)})" for k in range(n))
    return told.groupBy(*FRAME).agg(*map(F.expr, sums)).selectExpr(*FRAME, f"array_max(array({options})) AS best")


def relative_motion(pairs: DataFrame, fx: float, fy: float, cx: float, cy: float, least: int = 8, threshold: float = 1.0, tries: int = 256, pool: int = 512, keep: int = 8, far: float = 50.0, seed: int = 0) -> DataFrame:
    """Rotation and direction of motion of each frame from point pairs (seq_id, frame, idx, u0, v0, u1, v1; pixels).

    Hypotheses come from eight-point samples among at most `pool` pairs of a frame, drawn by hash; the `keep` best
    are voted on by all its pairs (`threshold` pixels of Sampson distance), the winner is fitted again to all pairs that
    voted for it, and the better of both stays. Of its four motions the one is taken under which most of its pairs
    lie in front of both views. Votes and sums are partial before they are shuffled, and a frame of very
    many pairs is dealt to lots, so one frame may hold most of the table.

    One row per frame: success, tracked, inliers, front (inliers in front), e, r (nine values by rows), t (unit
    length), status: 'insufficient' pairs, a 'non-finite' or null value, 'degenerate' spread (below one pixel on
    an axis), 'few inliers', or 'ok'; e, r and t are null unless it is 'ok'. Rows without seq_id or frame take no part;
    repeated rows count as often as they come.
    """
    if least < 8 or pool < 8 or min(tries, keep) < 1:
        raise ValueError("eight pairs are the least that a motion can be found from, and one try")
    limit = (threshold / ((fx + fy) / 2)) ** 2
    raw = ["u0", "v0", "u1", "v1"]
    given = pairs.select(*FRAME, "idx", *(F.col(c).cast("double").alias(c) for c in raw)).dropna(subset=FRAME)
    good = finite(*(F.col(c) for c in raw))
    moments = [f(F.when(good, F.col(c))).alias(f"{n}_{c}") for c in raw for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    frames = given.groupBy(*FRAME).agg(F.count("*").alias("tracked"), F.bool_and(good).alias("good"), *moments)
    flat = F.least(*(F.col(f"s_{c}") for c in raw)) < 1.0
    status = F.when(F.col("tracked") < least, "insufficient").when(~F.col("good"), "non-finite").when(flat, "degenerate").otherwise("ok")
    focal, middle = {"u": fx, "v": fy}, {"u": cx, "v": cy}
    mean = F.array(*((F.col(f"m_{c}") - middle[c[0]]) / focal[c[0]] for c in raw))
    spread = F.array(*(F.col(f"s_{c}") / focal[c[0]] for c in raw))
    lots = F.ceil(F.col("tracked") / LOT).cast("int")
    frames = saved(frames.select(*FRAME, "tracked", status.alias("status"), lots.alias("lots"), mean.alias("mean"), spread.alias("spread")))
    fit = frames.where("status = 'ok'").select(*FRAME, "lots", "mean", "spread")

    order = F.xxhash64("idx", *raw, F.lit(seed))
    lot = F.pmod(F.xxhash64("idx", *raw), F.col("lots")).cast("int")
    points = [((F.col(c) - middle[c[0]]) / focal[c[0]]).alias(x) for c, x in zip(raw, POINT, strict=True)]
    rows = saved(given.join(fit.select(*FRAME, "lots"), FRAME).select(*FRAME, "idx", order.alias("draw"), lot.alias("lot"), *points))

    drawn = rows.withColumn("n", F.row_number().over(Window.partitionBy(*FRAME).orderBy("draw", "idx", *POINT))).where(F.col("n") <= pool)
    sample = drawn.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("n", *POINT))).alias("sample")).select(*FRAME, F.flatten(F.transform("sample", lambda s: F.array(*(s[c] for c in POINT)))).alias("sample"))

    @F.pandas_udf("array<double>")
    def guess(samples: pd.Series) -> pd.Series:
        return pd.Series([hypotheses(np.asarray(s, float).reshape(-1, 4), tries, keep, limit, seed).ravel() for s in samples])

    first = saved(fit.join(sample, FRAME).select(*fit.columns, guess("sample").alias("e")))
    best = elected(rows, first, keep, limit).join(first, FRAME)
    best = saved(best.select(*fit.columns, F.slice("e", 1 - 9 * F.col("best.rank"), 9).alias("e")))

    scaled = [f"({x} - mean[{i}]) / spread[{i}]" for i, x in enumerate(POINT)]
    sides = [[*scaled[:2], "1D"], [*scaled[2:], "1D"]]
    near = with_errors(voting(rows, best), 1).where(f"err0 <= {limit!r}D")
    near = near.selectExpr(*FRAME, "lots", "mean", "spread", "e", *(f"{sides[1][i]} * {sides[0][j]} AS t{k}" for k, (i, j) in enumerate(MONOMIALS)))
    summed = near.groupBy(*FRAME).agg(*(F.first(c).alias(c) for c in ("lots", "mean", "spread", "e")), F.expr("array(" + ", ".join(f"sum(t{p} * t{q})" for p, q in UPPER) + ")").alias("sums"))

    @F.pandas_udf("struct<e: array<double>, p: array<double>>")
    def again(sums: pd.Series, means: pd.Series, spreads: pd.Series, winners: pd.Series) -> pd.DataFrame:
        es, ps = [], []
        for s, m, d, e in zip(sums, means, spreads, winners, strict=True):
            square = np.zeros((9, 9))
            square[tuple(np.array(UPPER).T)] = s
            square += np.triu(square, 1).T
            t0, t1 = scaling(np.asarray(m), np.asarray(d))
            fitted = essential(t1.T @ np.linalg.eigh(square)[1][:, 0].reshape(3, 3) @ t0)
            both = np.stack([np.asarray(e).reshape(3, 3), fitted])
            es.append(both.ravel())
            ps.append(poses(both).ravel())
        return pd.DataFrame({"e": es, "p": ps})

    second = saved(summed.select(*FRAME, "lots", again("sums", "mean", "spread", "e").alias("fit")).select(*FRAME, "lots", "fit.e", "fit.p"))
    last = elected(rows, second, 2, limit, far).join(second, FRAME)
    at = 1 - 48 * F.col("best.rank") - 12 * F.col("best.pose.rank")
    last = last.select(*FRAME, F.col("best.votes").alias("inliers"), F.col("best.pose.front").alias("front"), F.slice("e", 1 - 9 * F.col("best.rank"), 9).alias("e"), F.slice("p", at, 9).alias("r"), F.slice("p", at + 9, 3).alias("t"))
    out = frames.join(last, FRAME, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("inliers", "front")})
    final = F.when((F.col("status") == "ok") & (F.col("inliers") < least), "few inliers").otherwise(F.col("status"))
    out = out.withColumn("status", final)
    ok = F.col("status") == "ok"
    return out.select(*FRAME, ok.alias("success"), "tracked", "inliers", "front", *(F.when(ok, F.col(c)).alias(c) for c in ("e", "r", "t")), "status")
