"""Trajectory-error aggregates and alignment over pairs of estimated and true poses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .order import summarize
from .prefix import HOUR, neighbour, scan


def rmse(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def error_summary(error: Column, order: Column, prefix: str = "") -> list[Column]:
    """RMSE, mean, population deviation, extremes and last value of an error; medians are from order.py."""
    named = {"rmse": rmse(error), "mean": F.avg(error), "std": F.stddev_pop(error), "min": F.min(error), "max": F.max(error), "final": F.max_by(error, order)}
    return [c.alias(prefix + n) for n, c in named.items()]


def axis_summary(difference: Column, axis: str) -> list[Column]:
    return [rmse(difference).alias(f"rmse_{axis}"), F.avg(F.abs(difference)).alias(f"mae_{axis}"), F.max(F.abs(difference)).alias(f"max_{axis}")]


def path_length(rows: DataFrame, p: tuple[str, ...], seq: str = "seq_id", ts: str = "us", span: int = HOUR) -> DataFrame:
    rows = scan(rows.select(seq, ts, *p), span, seq=seq, ts=ts, _before=neighbour(F.struct(*p)))
    step = g.norm(tuple(F.col(c) - F.col(f"_before.{c}") for c in p))
    return rows.withColumn("step", step).groupBy(seq).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def length_ratio(est: Column, true: Column) -> Column:
    return F.when(true <= 1e-6, 1.0).otherwise(est / true)


def latency_summary(x: Column) -> list[Column]:
    named = {"count": F.count(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "total": F.sum(x)}
    return [c.alias(n) for n, c in named.items()]


def bounding_box(axes: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))]


def alignment_moments(pairs: DataFrame, src: tuple[str, ...], dst: tuple[str, ...], by: list[str]) -> DataFrame:
    """Counts, means, total source variance and the cross-covariance that an alignment needs."""
    aggs = [F.count("*").alias("n"), *(F.avg(c).alias(f"ms{i}") for i, c in enumerate(src)), *(F.avg(c).alias(f"md{i}") for i, c in enumerate(dst))]
    aggs.append((F.var_pop(src[0]) + F.var_pop(src[1]) + F.var_pop(src[2])).alias("variance"))
    aggs += [F.covar_pop(dst[i], src[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    return pairs.groupBy(*by).agg(*aggs)


def solve_alignment(moments: DataFrame, with_scale: bool, by: list[str]) -> DataFrame:
    """by, scale, r (9 values by rows), t (3) of the least-squares rotation, by SVD of one row of moments.

    Groups of fewer than 3 pairs or without spread have null results.
    """
    keys = {f.name: f.dataType.simpleString() for f in moments.schema if f.name in by}

    def run(frames):
        for t in frames:
            out = {**{k: t[k] for k in by}, "scale": [], "r": [], "t": []}
            for m in t.to_dict("records"):
                if m["n"] < 3 or not m["variance"] >= 1e-12:
                    for c in ("scale", "r", "t"):
                        out[c].append(None)
                    continue
                u, d, vt = np.linalg.svd(np.array([[m[f"c{i}{j}"] for j in range(3)] for i in range(3)]))
                s = np.ones(3)
                if np.linalg.det(u) * np.linalg.det(vt) < 0:
                    s[2] = -1
                r = u @ np.diag(s) @ vt
                scale = float((d * s).sum() / m["variance"]) if with_scale else 1.0
                shift = np.array([m[f"md{i}"] for i in range(3)]) - scale * r @ np.array([m[f"ms{i}"] for i in range(3)])
                out["scale"].append(scale)
                out["r"].append(r.reshape(-1).tolist())
                out["t"].append(shift.tolist())
            yield pd.DataFrame(out)

    return moments.mapInPandas(run, ", ".join([*(f"{k} {v}" for k, v in keys.items()), "scale double, r array<double>, t array<double>"]))


def apply_alignment(rows: DataFrame, fit: DataFrame, p: tuple[str, ...], by: list[str]) -> DataFrame:
    """Adds ax, ay, az: the aligned position."""
    moved = [F.col("scale") * sum((F.col("r")[3 * i + j] * F.col(c) for j, c in enumerate(p)), F.lit(0.0)) + F.col("t")[i] for i in range(3)]
    return rows.join(fit, by).withColumns(dict(zip(("ax", "ay", "az"), moved, strict=True))).drop("scale", "r", "t")


def relative_errors(ahead: DataFrame) -> DataFrame:
    """translation and rotation (degrees) error of each row with its `ahead` row; both carry est and true
    positions (px.., tx..) and quaternions (qw.., tw..)."""
    at = lambda p, names: tuple(F.col(f"{p}{n}") for n in names)
    pos, true = ("px", "py", "pz"), ("tx", "ty", "tz")
    q, tq = ("qw", "qx", "qy", "qz"), ("tw", "ti", "tj", "tk")
    moved = g.sub(g.sub(at("ahead.", pos), at("", pos)), g.sub(at("ahead.", true), at("", true)))
    turn = lambda n: g.q_product(g.q_conjugate(at("", n)), at("ahead.", n))
    return ahead.withColumns({"translation": g.norm(moved), "rotation": g.q_angle(turn(q), turn(tq))})


POS, TRUE_POS, VEL, TRUE_VEL = ("px", "py", "pz"), ("tx", "ty", "tz"), ("vx", "vy", "vz"), ("tvx", "tvy", "tvz")
QUAT, TRUE_QUAT = ("qw", "qx", "qy", "qz"), ("tw", "ti", "tj", "tk")


def evaluation(pairs: DataFrame, est: DataFrame, true: DataFrame, ahead: dict[str, DataFrame], span: int = HOUR) -> DataFrame:
    """All measures of each sequence in one row: counts of matched and unmatched poses, position errors as a
    whole and by axis, orientation errors as they are and as drift from the first pair, velocity errors (null
    unless every pair has both velocities), path lengths, relative errors for each of ahead (name: pairs with
    their `ahead` row), and the position errors left after rigid and similarity alignment.

    pairs are read several times: hand them in saved or cached. Sequences without a pair have no row.
    """
    by = ["seq_id"]
    diff = lambda a, b: g.sub(g.vec(*a), g.vec(*b))
    start = pairs.groupBy(*by).agg(F.min_by(F.struct(*QUAT, *TRUE_QUAT), F.struct("us", "event_id")).alias("start"))
    since = lambda names: g.q_product(g.q_conjugate(tuple(F.col(f"start.{c}") for c in names)), g.vec(*names))
    rows = pairs.join(start, by).withColumns(
        {
            "position_error": g.norm(diff(POS, TRUE_POS)),
            "orientation_error": g.q_angle(g.vec(*QUAT), g.vec(*TRUE_QUAT)),
            "drift": g.q_angle(since(QUAT), since(TRUE_QUAT)),
            "velocity_error": g.norm(diff(VEL, TRUE_VEL)),
        }
    )
    whole = lambda x, name: [rmse(F.col(x)).alias(f"{name}_rmse"), F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max")]
    aggs = [F.count("*").alias("matched"), F.count_distinct("other_id").alias("_used"), F.count("velocity_error").alias("_moving")]
    aggs += error_summary(F.col("position_error"), F.struct("us", "event_id"), "ate_")
    aggs += [c for p, t, a in zip(POS, TRUE_POS, "xyz", strict=True) for c in axis_summary(F.col(p) - F.col(t), a)]
    aggs += [*whole("orientation_error", "orientation"), *whole("drift", "drift"), *whole("velocity_error", "velocity")]
    middle = {"ate_median": "position_error", "orientation_median": "orientation_error", "drift_median": "drift", "velocity_median": "velocity_error"}
    out = summarize(rows, by, aggs, {n: (c, 0.5) for n, c in middle.items()})
    out = out.withColumns({c: F.when(F.col("_moving") == F.col("matched"), F.col(c)) for c in out.columns if c.startswith("velocity_")})
    for side, name in ((est, "n_est"), (true, "n_true")):
        out = out.join(side.groupBy(*by).agg(F.count("*").alias(name)), by, "left")
    out = out.withColumns({"unmatched_est": F.col("n_est") - F.col("matched"), "unmatched_true": F.col("n_true") - F.col("_used")})
    for names, name in ((POS, "est_length"), (TRUE_POS, "true_length")):
        out = out.join(path_length(pairs, names, span=span).withColumnRenamed("length", name), by, "left")
    out = out.withColumn("length_ratio", length_ratio(F.col("est_length"), F.col("true_length")))
    for name, later in ahead.items():
        aggs = [F.count("*").alias(f"{name}_n"), rmse(F.col("translation")).alias(f"{name}_translation_rmse"), F.avg("rotation").alias(f"{name}_rotation_mean")]
        out = out.join(relative_errors(later).groupBy(*by).agg(*aggs), by, "left")
    moments = alignment_moments(pairs, POS, TRUE_POS, by)
    for with_scale, name in ((False, "rigid"), (True, "similarity")):
        fit = solve_alignment(moments, with_scale, by)
        left = rmse(g.norm(diff(("ax", "ay", "az"), TRUE_POS)))
        out = out.join(apply_alignment(pairs, fit, POS, by).groupBy(*by).agg(left.alias(f"{name}_rmse")), by, "left")
        if with_scale:
            out = out.join(fit.select(*by, F.col("scale").alias("similarity_scale")), by, "left")
    return out.drop("_used", "_moving")
