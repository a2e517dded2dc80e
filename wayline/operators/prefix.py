"""Prefix scans along sequences, spread over spans of them.

A scan has two levels: within a span by a window, and over a sequence's spans by a window on a table of one row
for each span, which holds what all rows of a span come to. Both are put together by a join on the span. So a
sequence of any length is worked on by as many tasks as it has spans; only the table of spans has a sequence in
one task. Rows of a null sequence take no part; rows of null order lie in a span of their own, before all others.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

HOUR = 3_600_000_000
#: The span of rows without a place in the order.
NOWHERE = -(1 << 62)


class Scan(NamedTuple):
    """whole: what the rows of a span come to, given their order; carried: what the spans before come to, given a
    column of `whole` and the windows over the spans before and over all spans; here: what the span's rows up
    to this one come to, given windows up to this row, up to the one before, and without a frame; both: carried
    and here as one."""

    whole: Callable[[Column], Column]
    carried: Callable[[Column, WindowSpec, WindowSpec], Column]
    here: Callable[[WindowSpec, WindowSpec, WindowSpec], Column]
    both: Callable[[Column, Column], Column]
    forward: bool = False


def running_sum(x: Column) -> Scan:
    """Sum of x up to this row; null where none isn't null."""
    added = lambda a, b: F.coalesce(a + b, a, b)
    return Scan(lambda order: F.sum(x), lambda c, before, every: F.sum(c).over(before), lambda upto, ahead, plain: F.sum(x).over(upto), added)


def running_count(x: Column | None = None) -> Scan:
    """Number of rows up to this one, or of those where x isn't null."""
    x = F.lit(1) if x is None else x
    none = F.lit(0).cast("long")
    return Scan(lambda order: F.count(x), lambda c, before, every: F.sum(c).over(before), lambda upto, ahead, plain: F.count(x).over(upto), lambda c, h: F.coalesce(c, none) + h)


def running_max(x: Column) -> Scan:
    return Scan(lambda order: F.max(x), lambda c, before, every: F.max(c).over(before), lambda upto, ahead, plain: F.max(x).over(upto), lambda c, h: F.greatest(c, h))


def first_value(x: Column) -> Scan:
    """x of the sequence's first row, null or not."""
    x = F.struct(x.alias("x"))
    return Scan(lambda order: F.min_by(x, order), lambda c, before, every: F.first(c).over(before), lambda upto, ahead, plain: F.first(x).over(upto), lambda c, h: F.coalesce(c, h)["x"])


def total(x: Column) -> Scan:
    """Sum of x over the whole sequence, on each of its rows."""
    return Scan(lambda order: F.sum(x), lambda c, before, every: F.sum(c).over(every), lambda upto, ahead, plain: F.lit(None).cast("int"), lambda c, h: c)


def neighbour(x: Column, forward: bool = False) -> Scan:
    """x of the row before (or, forward, after), null or not; null where there is none."""
    x = F.struct(x.alias("x"))
    last = F.min_by if forward else F.max_by
    return Scan(lambda order: last(x, order), lambda c, before, every: F.last(c).over(before), lambda upto, ahead, plain: F.lag(x).over(plain), lambda c, h: F.coalesce(h, c)["x"], forward)


def nearest(x: Column, hit: Column, forward: bool = False, strict: bool = False) -> Scan:
    """x of the nearest row with hit up to this one (or, forward, from it on); strict leaves this row out."""
    x, last = F.when(hit, x), F.min_by if forward else F.max_by
    found = lambda order: last(x, F.when(x.isNotNull(), order))
    return Scan(found, lambda c, before, every: F.last(c, ignorenulls=True).over(before), lambda upto, ahead, plain: F.last(x, ignorenulls=True).over(ahead if strict else upto), lambda c, h: F.coalesce(h, c), forward)


def in_spans(rows: DataFrame, span: int, ts: str = "us") -> DataFrame:
    return rows.withColumn("_span", F.coalesce(F.floor(F.col(ts) / span), F.lit(NOWHERE)))


def scan(rows: DataFrame, span: int | None, order: list[str] | None = None, seq: str = "seq_id", ts: str = "us", **scans: Scan) -> DataFrame:
    """rows with a column for each of scans, along `order` (by default the time). span is a length of time, or None
    where rows have a column `_span` already, which must grow with the order."""
    order = order or [ts]
    kept = rows.columns
    rows = rows if span is None else in_spans(rows, span, ts)
    key = F.struct(*order)
    windows = {}
    for forward in (False, True):
        along = F.desc if forward else F.asc
        plain = Window.partitionBy(seq, "_span").orderBy(*map(along, order))
        spans = Window.partitionBy(seq).orderBy(along("_span"))
        begin = Window.unboundedPreceding
        windows[forward] = (plain.rowsBetween(begin, 0), plain.rowsBetween(begin, -1), plain), (spans.rowsBetween(begin, -1), Window.partitionBy(seq))
    table = rows.groupBy(seq, "_span").agg(*(s.whole(key).alias(f"_all_{n}") for n, s in scans.items()))
    table = table.select(seq, "_span", *(s.carried(F.col(f"_all_{n}"), *windows[s.forward][1]).alias(f"_from_{n}") for n, s in scans.items()))
    rows = rows.withColumns({f"_here_{n}": s.here(*windows[s.forward][0]) for n, s in scans.items()}).join(table, [seq, "_span"])
    done = {n: s.both(F.col(f"_from_{n}"), F.col(f"_here_{n}")) for n, s in scans.items()}
    return rows.select(*(F.col(f"`{c}`") for c in kept if c not in done), *(c.alias(n) for n, c in done.items()))
