"""Inertial steps as elements of a semigroup, combined in trees, so that long intervals are spread over tasks.

An element is what a stretch of samples does from rest at the origin, gravity left out: turn q, velocity v,
place p, time t. Two stretches one after the other are again one: q1 q2, v1 + q1 v2, p1 + v1 t2 + q1 p2, t1 + t2.
Gravity adds g t to the velocity and g t^2 / 2 to the place, whatever the turns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import HOUR, in_spans, neighbour, scan, total

GRAVITY, NOMINAL_DT = 9.81, 0.005
STATE = ("px", "py", "pz", "vx", "vy", "vz", "qw", "qx", "qy", "qz")
#: Columns of an element: STATE and the time.
ELEMENT = (*STATE, "t")
SAMPLE = ("ax", "ay", "az", "wx", "wy", "wz")


def turned(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows of v turned by rows of unit quaternions."""
    t = 2 * np.cross(q[:, 1:], v)
    return v + q[:, :1] * t + np.cross(q[:, 1:], t)


def steps(force: np.ndarray, rate: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """Elements (rows by ELEMENT) of single steps: specific force and angular rate for dt seconds."""
    dt = dt[:, None]
    size = np.linalg.norm(rate, axis=1, keepdims=True)
    half = size * dt / 2
    k = np.where(size * dt > 1e-8, np.sin(half) / np.where(size == 0, 1, size), dt / 2)
    return np.concatenate([force * dt * dt / 2, force * dt, np.cos(half), rate * k, dt], axis=1)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a, each followed by its row of b."""
    p, v, q, t = a[:, :3], a[:, 3:6], a[:, 6:10], a[:, 10:]
    w, x, y = b[:, 6:7], b[:, 7:10], q[:, 1:]
    new = np.concatenate([q[:, :1] * w - (y * x).sum(axis=1, keepdims=True), q[:, :1] * x + w * y + np.cross(y, x)], axis=1)
    new /= np.linalg.norm(new, axis=1, keepdims=True)
    return np.concatenate([p + v * b[:, 10:] + turned(q, b[:, :3]), v + turned(q, b[:, 3:6]), new, t + b[:, 10:]], axis=1)


def identity(n: int) -> np.ndarray:
    out = np.zeros((n, len(ELEMENT)))
    out[:, 6] = 1
    return out


def reduced(elements: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One element for each run of equal owners, and the owners: neighbours are paired until runs have one."""
    while True:
        same = owner[1:] == owner[:-1]
        if not same.any():
            return elements, owner
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        left = np.flatnonzero(place % 2 == 0)
        paired = left[(left + 1 < len(owner)) & np.append(same, False)[left]]
        elements[paired] = compose(elements[paired], elements[paired + 1])
        elements, owner = elements[left], owner[left]


def fallen(elements: np.ndarray) -> np.ndarray:
    """States of elements, gravity included."""
    t, out = elements[:, 10], elements[:, :10].copy()
    out[:, 2] += GRAVITY * t * t / 2
    out[:, 5] += GRAVITY * t
    return out


def _combined(rows: DataFrame, keys: list[str], finish: bool) -> DataFrame:
    """Rows (keys, ELEMENT), sorted by keys within their partitions and in order, as one row for each run of equal
    keys; with finish as states. Only a run's element is carried from batch to batch."""
    names = STATE if finish else ELEMENT
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        last, carried, kinds = None, None, None

        def made(found, values):
            values = fallen(values) if finish else values
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], t) for i, t in enumerate(kinds)), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(names)))], [*keys, *names])

        for batch in batches:
            kinds = kinds or [batch.column(c).type for c in keys]
            if not len(batch):
                continue
            at = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            owner = np.cumsum([0, *(a != b for a, b in zip(at, at[1:], strict=False))])
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ELEMENT])
            if last == at[0]:
                values, owner = np.concatenate([carried, values]), np.concatenate([[0], owner])
            elif last is not None:
                yield made([last], carried)
            heads = [at[int(i)] for i in np.searchsorted(owner[-len(at) :], np.arange(owner[-1] + 1))]
            values, _ = reduced(values, owner)
            yield made(heads[:-1], values[:-1])
            last, carried = heads[-1], values[-1:]
        if last is not None:
            yield made([last], carried)

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), *(f"{c} double" for c in names)]))


def integrate_rows(samples: DataFrame, keys: list[str], span: int = HOUR, start: DataFrame | None = None) -> DataFrame:
    """keys and STATE after the samples of each interval, from rows (keys, us, SAMPLE), one for each sample.

    Samples are cut into spans of time; a span's steps are combined in a task, an interval's spans, one element
    each, in another. So an interval of any length is spread, and a task holds a batch. n samples give n - 1
    steps, each to the next sample's time; one alone has a nominal step. Intervals begin at rest at the
    origin, or, where start (keys, STATE) has them, there; to go on from there, the samples begin with the last
    one of before. Rows with a null key take no part.
    """
    parts = max(1, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = in_spans(samples.select(*keys, "us", *SAMPLE), span).withColumn("_key", F.struct(*keys)).dropna(subset=keys)
    rows = scan(rows, None, seq="_key", _next=neighbour(F.col("us"), forward=True), _n=total(F.lit(1)))
    dt = F.when(F.col("_next").isNotNull(), (F.col("_next") - F.col("us")) * 1e-6).when(F.col("_n") == 1, NOMINAL_DT)
    rows = rows.withColumn("_dt", dt).where("_dt is not null").repartition(parts, *keys, "_span").sortWithinPartitions(*keys, "_span", "us")
    by = [*keys, "_span"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            get = lambda *names: np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])  # noqa: B023, E731
            values = steps(get("ax", "ay", "az"), get("wx", "wy", "wz"), get("_dt")[:, 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(ELEMENT)))], [*by, *ELEMENT])

    each = rows.select(*by, *SAMPLE, "_dt").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"{c} double" for c in ELEMENT)]))
    spans = _combined(each, by, False)
    if start is not None:
        begun = samples.select(*keys).distinct().join(start, keys)
        first = -(1 << 63)
        spans = spans.unionByName(begun.select(*keys, F.lit(first).cast("long").alias("_span"), *STATE, F.lit(0.0).alias("t")))
    return _combined(spans.repartition(parts, *keys).sortWithinPartitions(*by).select(*keys, *ELEMENT), keys, True)
