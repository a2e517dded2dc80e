"""Features, scaling, a small network's scores, gating, and its training."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .prefix import HOUR, neighbour, running_count, scan, total

#: The order of the features and the network's layers.
FEATURES = ["tracked_features", "inlier_ratio", "mean_flow", "std_flow", "mean_ax", "mean_ay", "mean_az", "var_ax", "var_ay", "var_az", "mean_wx", "mean_wy", "mean_wz", "vx", "vy", "vz", "speed", "dt"]
LAYERS = {"shared.0": (32, 18), "shared.2": (16, 32), "residual_head": (3, 16), "confidence_head.0": (1, 16)}


def interval_stats(samples: Column, fields: list[str], name) -> dict[str, Column]:
    """Mean and population variance over an array of samples; zeros for none or any non-finite value."""
    n = F.size(samples)
    total = lambda f: F.aggregate(samples, F.lit(0.0), lambda s, x: s + f(x))
    ok = (n > 0) & F.forall(samples, lambda x: g.finite(*(x[c] for c in fields)))
    count = F.greatest(n, F.lit(1))
    out = {}
    for c in fields:
        mean = total(lambda x, c=c: x[c]) / count
        out[name("mean", c)] = F.when(ok, mean).otherwise(0.0)
        out[name("var", c)] = F.when(ok, total(lambda x, c=c, mean=mean: (x[c] - mean) * (x[c] - mean)) / count).otherwise(0.0)
    return out


def with_steps(rows: DataFrame, span: int = HOUR, name: str = "dt") -> DataFrame:
    """Adds prev_us, the time of the row before, and `name`, the seconds since, at least 1e-4; 0.05 for the first."""
    rows = scan(rows, span, prev_us=neighbour(F.col("us")))
    step = F.greatest((F.col("us") - F.col("prev_us")) * 1e-6, F.lit(1e-4))  # greatest() skips nulls
    return rows.withColumn(name, F.when(F.col("prev_us").isNull(), 0.05).otherwise(step))


def scaler_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean_<name>, std_<name>; a deviation under 1e-4 counts as 1."""
    std = lambda c: F.when(F.stddev_pop(c) < 1e-4, 1.0).otherwise(F.stddev_pop(c))
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in names), *(std(c).alias(f"std_{c}") for c in names))


def scaled(rows: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """rows with names standardized, non-finite results scrubbed to 0 and +-5; stats is one row."""
    out = rows.crossJoin(F.broadcast(stats))
    return out.select(*[c for c in rows.columns if c not in names], *(g.scrub((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}"), 5.0).alias(c) for c in names))


def seeded_weights(seed: int = 42) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for name, (rows, cols) in LAYERS.items():
        out[f"{name}.weight"] = np.round(rng.normal(0, 1 / np.sqrt(cols), (rows, cols)), 6)
        out[f"{name}.bias"] = np.round(rng.normal(0, 0.1, rows), 6)
    return out


def network(rows: DataFrame, x: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """rows with dvx, dvy, dvz, confidence from the array column x: one matrix product per layer and Arrow batch.

    Column expressions over arrays of weights are interpreted row by row, about a hundred times slower.
    """
    names = ("dvx", "dvy", "dvz", "confidence")

    def run(batches):
        for batch in batches:
            v = batch.column(x).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for name in ("shared.0", "shared.2"):
                v = np.maximum(v @ weights[f"{name}.weight"].T + weights[f"{name}.bias"], 0)
            dv = v @ weights["residual_head.weight"].T + weights["residual_head.bias"]
            logit = v @ weights["confidence_head.0.weight"][0] + weights["confidence_head.0.bias"][0]
            out = [*dv.T, 1 / (1 + np.exp(-np.clip(logit, -15, 15)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in out)], [*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} double" for c in names)])
    return rows.mapInArrow(run, schema)


def gate(dv: g.Vec, confidence: Column, low: float = 0.2, full: float = 0.5, most: float = 3.0) -> tuple[g.Vec, Column]:
    """Clamped corrections scaled by the confidence's ramp, and the confidence; zeros if not finite."""
    ok = g.finite(*dv, confidence)
    share = F.when(confidence <= low, 0.0).when(confidence < full, (confidence - low) / (full - low)).otherwise(1.0)
    return tuple(F.when(ok, g.clip(d, -most, most) * share).otherwise(0.0) for d in dv), F.when(ok, confidence).otherwise(0.0)


def chronological(rows: DataFrame, share: float = 0.7, span: int = HOUR) -> DataFrame:
    """Adds part: train for the first int(n * share) rows of a sequence by time, else test."""
    numbered = scan(rows, span, _place=running_count(), _rows=total(F.lit(1)))
    return numbered.withColumn("part", F.when(F.col("_place") <= F.floor(F.col("_rows") * share), "train").otherwise("test")).drop("_place", "_rows")


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, n: int) -> tuple[float, dict[str, np.ndarray]]:
    """What the rows x, y add to the loss and its gradients in a batch of n rows: mean squared error
    + 0.05 * mean((1 - confidence)**2)."""
    a1 = x @ p["shared.0.weight"].T + p["shared.0.bias"]
    h1 = np.maximum(a1, 0)
    a2 = h1 @ p["shared.2.weight"].T + p["shared.2.bias"]
    h2 = np.maximum(a2, 0)
    dv = h2 @ p["residual_head.weight"].T + p["residual_head.bias"]
    c = 1 / (1 + np.exp(-np.clip(h2 @ p["confidence_head.0.weight"].T + p["confidence_head.0.bias"], -15, 15)))
    loss = (((dv - y) ** 2).sum() / y.shape[1] + 0.05 * ((1 - c) ** 2).sum()) / n
    gd, gc = 2 * (dv - y) / (n * y.shape[1]), -0.1 * (1 - c) * c * (1 - c) / n
    g2 = (gd @ p["residual_head.weight"] + gc @ p["confidence_head.0.weight"]) * (a2 > 0)
    g1 = (g2 @ p["shared.2.weight"]) * (a1 > 0)
    found = {"residual_head": (gd, h2), "confidence_head.0": (gc, h2), "shared.2": (g2, h1), "shared.0": (g1, x)}
    return float(loss), {k: v for name, (d, h) in found.items() for k, v in ((f"{name}.weight", d.T @ h), (f"{name}.bias", d.sum(axis=0)))}


class Adam:
    """Adam's steps on named arrays, in place, with weight decay added to the gradients."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, decay: float):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, grad in grads.items():
            grad = grad + self.decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.999 * self.v[k] + 0.001 * grad**2
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 32, rate: float = 1e-3, decay: float = 1e-4, seed: int = 42) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights fitted by Adam in batches, and losses by epoch.

    For the training set of one flight (thousands of rows) in arrays; `train_rows` takes tables of any size.
    """
    rng = np.random.default_rng(seed)
    p = {k: v.astype(float) for k, v in seeded_weights(seed).items()}
    adam, losses = Adam(p, rate, decay), []
    for _ in range(epochs):
        total, order = 0.0, rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            loss, grads = gradients(p, x[at], y[at], len(at))
            adam.step(grads)
            total += loss * len(at)
        losses.append(total / len(x))
    return p, losses


def train_rows(rows: DataFrame, x: list[str], y: list[str], epochs: int = 40, rate: float = 1e-2, decay: float = 1e-4, seed: int = 42) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights fitted by Adam to all rows, one step an epoch, and the losses before each step.

    Tasks sum the gradients of their own rows, a shuffle adds them up by parameter, so the driver gets one
    number for each parameter (about 1,200) whatever the rows. rows is read once an epoch: hand it in saved.
    No rows leave the weights as they start, with no losses.
    """
    p = {k: v.astype(float) for k, v in seeded_weights(seed).items()}
    n, adam, losses, ends = rows.count(), Adam(p, rate, decay), [], np.cumsum([v.size for v in p.values()])
    if not n:
        return p, losses

    def summed(weights):
        def run(batches):
            total = None
            for b in batches:
                at = lambda names, b=b: np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
                loss, grads = gradients(weights, at(x), at(y), n)
                one = np.concatenate([*(grads[k].reshape(-1) for k in weights), [loss]])
                total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        return run

    for _ in range(epochs):
        weights = {k: v.copy() for k, v in p.items()}
        got = rows.select(*x, *y).mapInArrow(summed(weights), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        flat = np.array([r.v for r in got])
        losses.append(float(flat[-1]))
        adam.step({k: part.reshape(p[k].shape) for k, part in zip(p, np.split(flat[:-1], ends[:-1]), strict=True)})
    return p, losses
