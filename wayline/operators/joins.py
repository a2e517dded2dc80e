"""Joins along time within a sequence: interval, nearest, ahead.

Rows of both sides are tagged, united and read by prefix scans (prefix.py), so no range condition reaches the
planner and a sequence of any length is spread over tasks. All frames grow from their partition's start, in
ascending or descending order, so a span of n rows takes n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import HOUR, nearest, running_count, scan


def seek(rows: DataFrame, hit: Column, payload: Column, name: str, forward: bool, span: int, order: list[str], strict: bool = False, seq: str = "seq_id", ts: str = "us") -> DataFrame:
    """Adds `name`: payload of the nearest row with `hit`, from this row on (or up to it), in `order`; with
    strict this row itself doesn't count."""
    return scan(rows, span, order, seq, ts, **{name: nearest(payload, hit, forward, strict)})


def interval_join(frames: DataFrame, samples: DataFrame, fields: list[str], include_first: bool = True, span: int = HOUR) -> DataFrame:
    """One row per frame (seq_id, us): start_us, samples (array of us and fields, by time) with
    start_us < us <= frame us.

    The first frame has a null start and no samples; with include_first false it is left out. Samples up
    to the first frame or after the last are dropped. Frames without samples stay, with an empty array.
    """
    frames = frames.select("seq_id", "us").distinct()
    frames = seek(frames, F.lit(True), F.col("us"), "start_us", False, span, ["us"], strict=True)
    tagged = samples.select("seq_id", "us", F.lit(0).alias("side"), F.struct("us", *fields).alias("sample")).unionByName(frames.select("seq_id", "us", F.lit(1).alias("side")), allowMissingColumns=True)
    owned = seek(tagged, F.col("side") == 1, F.col("us"), "end_us", True, span, ["us", "side"]).where("side = 0 and end_us is not null")
    nested = owned.groupBy("seq_id", "end_us").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    out = frames.join(nested.withColumnRenamed("end_us", "us"), ["seq_id", "us"], "left")
    empty = F.filter("samples", lambda s: F.lit(False))
    none = F.coalesce(empty, F.array().cast(nested.schema["samples"].dataType))
    out = out.withColumn("samples", F.when(F.col("start_us").isNull() | F.col("samples").isNull(), none).otherwise(F.col("samples")))
    return out if include_first else out.where("start_us is not null")


def require_samples(joined: DataFrame) -> DataFrame:
    """Fails when read if an interval has no sample."""
    ok = F.col("start_us").isNull() | (F.size("samples") > 0)
    return joined.where(ok | F.raise_error(F.concat(F.lit("no sample in the interval that ends at "), F.col("us"))).cast("boolean"))


def nearest_asof(left: DataFrame, right: DataFrame, tolerance_us: int, span: int = HOUR) -> DataFrame:
    """Rows of left (seq_id, us, ...) with `other` (struct of right's columns) and diff_us of the nearest
    row of right; other is null beyond the tolerance. A tie goes to the later one; right rows may serve
    several left rows."""
    if not tolerance_us > 0:
        raise ValueError("the tolerance must be above zero")
    own, them = F.struct(*left.columns), F.struct(*right.columns)
    rows = left.select("seq_id", "us", F.lit(0).alias("side"), own.alias("own")).unionByName(right.select("seq_id", "us", F.lit(1).alias("side"), them.alias("them")), allowMissingColumns=True)
    right_row = F.col("side") == 1
    rows = scan(rows, span, ["us", "side"], after=nearest(F.col("them"), right_row, True), before=nearest(F.col("them"), right_row)).where("side = 0")
    ahead, behind = F.col("after.us") - F.col("us"), F.col("us") - F.col("before.us")
    later = behind.isNull() | (ahead <= behind)
    best = F.when(later, F.col("after")).otherwise(F.col("before"))
    diff = F.when(later, ahead).otherwise(behind)
    rows = rows.withColumn("diff_us", diff).withColumn("other", F.when(diff <= tolerance_us, best))
    return rows.select("own.*", F.when(F.col("other").isNotNull(), F.col("diff_us")).alias("diff_us"), "other")


def first_after(rows: DataFrame, delta_us: int, span: int) -> DataFrame:
    """Each row with `ahead`: the first row at or after us + delta (of equal times the least), or null."""
    own, seen = F.struct(*rows.columns), F.struct("us", *[c for c in rows.columns if c not in ("seq_id", "us")])
    asked = rows.select("seq_id", (F.col("us") + delta_us).alias("us"), F.lit(0).alias("side"), own.alias("own"))
    both = asked.unionByName(rows.select("seq_id", "us", F.lit(1).alias("side"), seen.alias("seen")), allowMissingColumns=True)
    return seek(both, F.col("side") == 1, F.col("seen"), "ahead", True, span, ["us", "side", "seen"]).where("side = 0").select("own.*", "ahead")


def ahead_in_time(rows: DataFrame, delta_us: int, slack_us: int, span: int = HOUR) -> DataFrame:
    """Each row with `ahead`: the first row at or after us + delta, less than slack past it; others go."""
    return first_after(rows, delta_us, span).where(F.col("ahead.us") < F.col("us") + delta_us + slack_us)


def ahead_or_last(rows: DataFrame, delta_us: int, share: float = 0.9, span: int = HOUR) -> DataFrame:
    """Each row with the first row at or after us + delta or else the last row, if at least share * delta away."""
    fields = F.struct("us", *[c for c in rows.columns if c not in ("seq_id", "us")])
    last = rows.groupBy("seq_id").agg(F.max(fields).alias("_last"))
    out = first_after(rows, delta_us, span).join(last, "seq_id")
    out = out.withColumn("ahead", F.coalesce("ahead", "_last")).drop("_last")
    return out.where(F.col("ahead.us") - F.col("us") >= share * delta_us).select(*rows.columns, "ahead")


def ahead_by_rows(rows: DataFrame, k: int, span: int = HOUR) -> DataFrame:
    """Each row with the k-th row after it: rows are numbered, then joined with those k further on."""
    fields = F.struct("us", *[c for c in rows.columns if c not in ("seq_id", "us")])
    numbered = scan(rows, span, _n=running_count())
    later = numbered.select("seq_id", (F.col("_n") - k).alias("_n"), fields.alias("ahead"))
    return numbered.join(later, ["seq_id", "_n"]).select(*rows.columns, "ahead")


def nearest_points(points: DataFrame, radius: float) -> DataFrame:
    """For each point (seq_id, frame, idx, u, v) the nearest one of the frame before: prev_idx, distance.

    Cells of one radius bound the search to the nine around a point; ties go to the lowest index; beyond
    the radius prev_idx is null. Several points may share one.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    here = points.withColumns({"cu": cell("u"), "cv": cell("v")})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    before = here.select("seq_id", (F.col("frame") + 1).alias("frame"), F.col("idx").alias("prev_idx"), F.col("u").alias("pu"), F.col("v").alias("pv"), "cu", "cv", F.explode(around).alias("d"))
    before = before.select("seq_id", "frame", "prev_idx", "pu", "pv", (F.col("cu") + F.col("d.i")).alias("cu"), (F.col("cv") + F.col("d.j")).alias("cv"))
    distance = F.sqrt((F.col("u") - F.col("pu")) ** 2 + (F.col("v") - F.col("pv")) ** 2)
    near = here.join(before, ["seq_id", "frame", "cu", "cv"]).withColumn("distance", distance).where(F.col("distance") < radius)
    best = near.groupBy("seq_id", "frame", "idx").agg(F.min(F.struct("distance", "prev_idx")).alias("best"))
    return points.join(best, ["seq_id", "frame", "idx"], "left").select(*points.columns, "best.prev_idx", "best.distance")
