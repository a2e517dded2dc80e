"""Checks of streams: tables of violations, flags, and enforcement on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import finite


def order_violations(rows: DataFrame, strict: bool, seq: str = "seq_id", ts: str = "us", tie: str | None = None) -> DataFrame:
    """Rows whose time is null, negative, or not above (strict) / below (else) the one before in file order.

    `tie` is the column of file order; without it rows are taken in time order, so only equal times count.
    """
    w = Window.partitionBy(seq).orderBy(tie or ts)
    before = F.lag(ts).over(w)
    bad = F.col(ts) <= before if strict else F.col(ts) < before
    reason = F.when(F.col(ts).isNull(), "missing").when(F.col(ts) < 0, "negative").when(bad, "not increasing" if strict else "decreasing")
    return rows.withColumn("before", before).withColumn("reason", reason).where("reason is not null")


def enforce(violations: DataFrame, what: str) -> None:
    """Raises ValueError with the first violations, if there are any."""
    found = violations.limit(3).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in found))


def monotonic(ts: str = "us", seq: str = "seq_id") -> Column:
    return F.coalesce(F.col(ts) > F.lag(ts).over(Window.partitionBy(seq).orderBy("event_id")), F.lit(True))


def all_finite(*names: str) -> Column:
    return finite(*(F.col(n) for n in names))


def track_kept(width: float, height: float, limit: float = 1.0) -> Column:
    """Forward and backward found, returned within `limit` pixels, inside the image, finite."""
    inside = (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)
    return F.coalesce(F.col("forward_ok") & F.col("backward_ok") & (F.col("back_error") < limit) & inside & finite(F.col("u"), F.col("v")), F.lit(False))


def spread_status(points: DataFrame, by: list[str], least: int) -> DataFrame:
    """Per group of points (u, v): their number and whether they are too few, not finite or degenerate."""
    ok = finite(F.col("u"), F.col("v"))
    stats = points.groupBy(*by).agg(F.count("*").alias("points"), F.bool_and(ok).alias("ok"), F.stddev_pop(F.when(ok, F.col("u"))).alias("su"), F.stddev_pop(F.when(ok, F.col("v"))).alias("sv"))
    status = F.when(F.col("points") < least, "insufficient").when(~F.col("ok"), "non-finite").when((F.col("su") < 1.0) | (F.col("sv") < 1.0), "degenerate").otherwise("ok")
    return stats.select(*by, "points", status.alias("status"))


def rotation_faults(r: list[Column], tolerance: float = 1e-3) -> Column:
    """Why nine values by rows aren't a rotation: not finite, not orthonormal, wrong determinant; else null."""
    rows = [r[0:3], r[3:6], r[6:9]]
    far = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            product = sum((a * b for a, b in zip(rows[i], rows[j], strict=True)), F.lit(0.0))
            far = F.greatest(far, F.abs(product - (1.0 if i == j else 0.0)))
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    return F.when(~finite(*r), "non-finite").when(far > tolerance, "not orthonormal").when(F.abs(det - 1.0) > tolerance, "determinant")
