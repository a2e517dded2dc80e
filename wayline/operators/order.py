"""Exact order statistics of groups of any size, by narrowing brackets.

What a pass aggregates is a histogram: counts, least and greatest value by bin, at most BINS rows a group and
rank, added up on the map side. The bin that holds a rank is its next bracket. Once a bracket holds few values,
these alone are sorted. No buffer grows with a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import saved

#: Bins of a pass, and values that may be sorted for a rank.
BINS, FEW = 256, 4096
#: Doublings from the least to the greatest distance of two doubles.
OCTAVES = 2200


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], stored: bool = False, few: int = FEW) -> DataFrame:
    """by and, for each name: (column, share) of wanted, the value at that share of the column's sorted values,
    interpolated between neighbours; one row for each group of rows.

    Values that are null or not finite take no part; where none is left the result is null. With stored, rows are
    cheap to read again; else the values are written once. All groups and ranks advance in the same passes, at
    most two for each factor of BINS by which the largest group exceeds `few`, unless values crowd together.
    """
    groups = rows.select(*by).distinct() if by else None
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_whole"))
    columns = sorted({c for c, _ in wanted.values()})
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    values = rows.select(key.alias("k"), each.alias("e")).select("k", "e.m", "e.v").where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    values = values if stored else saved(values)
    asked = [(n, columns.index(c), p, up) for n, (c, p) in wanted.items() for up in (0, 1)]
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("of"), F.lit(float(p)).alias("p"), F.lit(up).alias("up")) for n, m, p, up in asked)))
    sizes = values.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.col("p") * (F.col("n") - 1)
    ranks = sizes.withColumn("a", asked).select("k", "m", "n", "lo", "hi", "a.*").where("m = of")
    # rank: how many values of the bracket come before the one looked for
    ranks = ranks.select("k", "m", "name", "up", (place - F.floor(place)).alias("part"), F.when(F.col("up") == 1, F.ceil(place)).otherwise(F.floor(place)).alias("rank"), "n", "lo", "hi")
    wide = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    ranks, turn = saved(ranks), 0
    while (open_ := ranks.where(wide)).limit(1).count():
        away = F.col("v") / 2 - F.col("lo") / 2
        share = away / (F.col("hi") / 2 - F.col("lo") / 2)
        # every other pass has bins of equal ratio, so that values over many orders of magnitude come apart too
        scaled = share if turn % 2 == 0 else F.when(share > 0, 1 + F.log2(share) / OCTAVES).otherwise(0.0)
        bin_ = F.when(F.col("v") >= F.col("hi"), BINS - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(BINS - 2), F.floor(scaled * (BINS - 1)))))
        inside = values.join(open_.withColumnRenamed("n", "_n"), ["k", "m"]).where("v between lo and hi")
        bins = inside.groupBy("k", "m", "name", "up", "part", "rank", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "m", "name", "up").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("before", before).where("before <= rank and rank < before + n").withColumn("rank", F.col("rank") - F.col("before"))
        ranks, turn = saved(ranks.where(~wide).unionByName(bins.select(*ranks.columns))), turn + 1
    flat = ranks.where("lo = hi").select("k", "name", "up", "part", F.col("lo").alias("v"))
    last = values.join(ranks.where("lo < hi"), ["k", "m"]).where("v between lo and hi")
    last = last.withColumn("i", F.row_number().over(Window.partitionBy("k", "m", "name", "up").orderBy("v")) - 1).where("i = rank").select("k", "name", "up", "part", "v")
    side = lambda n, up: F.max(F.when((F.col("name") == n) & (F.col("up") == up), F.col("v")))
    part = lambda n: F.max(F.when(F.col("name") == n, F.col("part")))
    ends = {f"_{n}{up}": side(n, up) for n in wanted for up in (0, 1)} | {f"_{n}p": part(n) for n in wanted}
    found = flat.unionByName(last).groupBy("k").agg(*(c.alias(a) for a, c in ends.items()))
    value = lambda n: F.when(F.col(f"_{n}p") == 0, F.col(f"_{n}0")).otherwise(F.col(f"_{n}0") * (1 - F.col(f"_{n}p")) + F.col(f"_{n}1") * F.col(f"_{n}p")).alias(n)
    if groups is None:  # one row, even of none
        return rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("_whole")).alias("k")).join(found, "k", "left").select(*(value(n) for n in wanted))
    return groups.select(F.struct(*by).alias("k")).join(found, "k", "left").select("k.*", *(value(n) for n in wanted))


def summarize(rows: DataFrame, by: list[str], aggregates: list, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """rows.groupBy(by).agg(aggregates) with the quantiles wanted; rows are written once, with the columns that
    they have."""
    rows = saved(rows)
    key = F.struct(*by).alias("_key") if by else F.lit(0).alias("_key")
    told = rows.groupBy(*by).agg(*aggregates).withColumn("_key", key)
    middle = quantiles(rows, by, wanted, stored=True)
    middle = middle.select((F.struct(*by) if by else F.lit(0)).alias("_key"), *wanted)
    return told.join(middle, "_key").drop("_key")
