"""The strongest points of each frame that keep a least distance from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import saved

FRAME = ["seq_id", "frame"]


def strongest_points(points: DataFrame, distance: float, most: int | None = None) -> DataFrame:
    """The points (seq_id, frame, idx, u, v, strength) that are left when points are taken by descending strength,
    ties by idx, and each one less than `distance` from one taken before is left out; of these the first `most` of
    each frame, with their rank from 1.

    Taken in rounds, all frames and places at once. Cells are so small that a cell holds one taken point at most,
    so only its strongest open point counts: it is taken once no nearby cell has a stronger open one, and what lies
    too near to it is closed. So a round handles one point a cell, and a dense cell never meets itself in pairs;
    the strongest open point of a frame is taken in every round. Points without a place or strength take no part.
    """
    if not distance > 0:
        raise ValueError("the distance must be above zero")
    side = distance / 2  # the diagonal of a cell is below the distance
    reach = 2  # and cells whose points can be that near are two apart at most, or three at a bound that rounding moves
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in ("u", "v", "strength")]
    rows = points.select(*FRAME, "idx", "u", "v", "strength").where(ok[0] & ok[1] & ok[2] & F.col("idx").isNotNull()).dropna(subset=FRAME).distinct()
    order = F.struct(F.col("strength").alias("s"), (-F.col("idx")).alias("i"), "u", "v")
    open_ = saved(rows.withColumns({"cu": F.floor(F.col("u") / side), "cv": F.floor(F.col("v") / side), "order": order}))
    steps_ = range(-reach - 1, reach + 2)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps_ for j in steps_))
    cell, squared = [*FRAME, "cu", "cv"], distance * distance

    def near(tops: DataFrame) -> DataFrame:
        """tops once for each cell that may have a point less than distance from them, in place of their own."""
        gap = lambda c, x: F.greatest(F.col(c) * side - F.col(x), F.col(x) - (F.col(c) + 1) * side, F.lit(0.0))
        out = tops.withColumn("d", F.explode(around)).withColumns({"cu": F.col("cu") + F.col("d.i"), "cv": F.col("cv") + F.col("d.j"), "home": (F.col("d.i") == 0) & (F.col("d.j") == 0)})
        return out.where(gap("cu", "order.u") ** 2 + gap("cv", "order.v") ** 2 < squared * 1.000001).drop("d")

    taken = []
    while open_.limit(1).count():
        tops = open_.groupBy(*cell).agg(F.max("order").alias("order"))
        rivals = near(tops.withColumns({"hu": F.col("cu"), "hv": F.col("cv")})).join(tops.withColumnRenamed("order", "rival"), cell, "left")
        chosen = rivals.groupBy(*FRAME, F.col("hu").alias("cu"), F.col("hv").alias("cv")).agg(F.first("order").alias("order"), F.max("rival").alias("rival")).where("order >= rival").drop("rival")
        # of the taken points near a cell few can be near a point, and there is one in a cell at most
        there = near(chosen).groupBy(*cell).agg(F.collect_list(F.struct("home", "order")).alias("there"))
        apart = lambda t: (F.col("u") - t["order"]["u"]) ** 2 + (F.col("v") - t["order"]["v"]) ** 2 >= squared
        state = open_.join(there, cell, "left").withColumn("taken", F.coalesce(F.exists("there", lambda t: t["home"] & (t["order"] == F.col("order"))), F.lit(False)))
        state = saved(state.where(F.col("taken") | F.col("there").isNull() | F.forall("there", apart)).drop("there"))
        taken.append(state.where("taken").select(*rows.columns))
        open_ = state.where("not taken").drop("taken")
    out = rows.limit(0)
    for part in taken:
        out = out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("strength"), "idx")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)
