"""Quality by Bradley-Terry ranking: scores learned from all preference pairs, cut at the score that splits the labels best.

Every row labelled good is preferred to every row labelled bad. The loss of a pair depends on the difference of two
scores only, so the pairs are never listed: scores are told apart by intervals of width SPAN, in each of which the
loss and its two derivatives are polynomials of degree NODES - 1 but for less than 2e-12 (Chebyshev interpolation,
measured). A pass over the rows sums, for each label, interval and node, how much of 1, x and x x^T lies there; the sums over
all pairs of rows then are sums over pairs of nodes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import neighbour, running_count, running_sum, scan
from .stats import COUNTS, text_counts
from .toxicity import held_out
from .workspace import Workspace

#: Pairs that each row of the rarer label is in; None: one with every row of the other label.
PAIRS: int | None = None
SPAN, NODES = 2.0, 16
PRIOR, OFFSET = 20.0, 0.02
RATES = ["n_symbols", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_stops", "n_lines", "n_stutter"]
FEATURES = ["length", "word_length", "variety", "dup_lines", *(f"r_{c}" for c in RATES), "few_words", "mixed_symbols"]


def feature_columns() -> list[Column]:
    n = F.col("n_words") + PRIOR
    rate = lambda c: F.log(OFFSET + F.col(c) / n)
    return [
        F.log1p("n_words").alias("length"),
        F.log((F.col("word_chars") + 5 * PRIOR) / n).alias("word_length"),
        F.log((F.col("n_distinct") + PRIOR) / n).alias("variety"),
        F.log(OFFSET + F.col("n_dup_lines") / (F.col("n_lines") + 5)).alias("dup_lines"),
        *(rate(c).alias(f"r_{c}") for c in RATES),
        F.when(F.col("n_words") < 20, 1.0).otherwise(0.0).alias("few_words"),
        (rate("n_symbols") * rate("n_upper")).alias("mixed_symbols"),
    ]


def newton(measure: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], d: int) -> np.ndarray:
    """Where a strictly convex function of d weights is least; measure gives its value, slope and second derivatives."""
    w = np.zeros(d)
    now, grad, hess = measure(w)
    while True:
        step, t = np.linalg.solve(hess, grad), 1.0
        if np.abs(step).max() < 1e-8:
            return w - step
        made = measure(w - step)
        while t > 1e-6 and made[0] > now - 1e-4 * t * (grad @ step) + 1e-12 * abs(now):
            t /= 2
            made = measure(w - t * step)
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            return w
        now, grad, hess = made


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights w that maximize the likelihood of sigmoid(w . (better - worse)) over listed pairs, by Newton steps."""
    x = better - worse

    def measure(w):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        return np.logaddexp(0, -(x @ w)).sum() + ridge / 2 * w @ w, -(x * p[:, None]).sum(axis=0) + ridge * w, hess

    return newton(measure, x.shape[1])


def pairs_of(y: np.ndarray, per_row: int | None = PAIRS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse) rows, listed: all of them, or, with per_row, so many that each row of either label meets at least
    one of the other, the rarer ones at least per_row."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if per_row is None:
        return np.repeat(good, len(bad)), np.tile(bad, len(good))
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad), per_row * min(len(good), len(bad)))
    deal = lambda x: np.concatenate([rng.permutation(x) for _ in range(-(-n // len(x)))])[:n]
    return deal(good), deal(bad)


_ANGLES, _K = (np.arange(NODES) + 0.5) * np.pi / NODES, np.arange(NODES)
#: From Chebyshev polynomials to the polynomials that are 1 at one node and 0 at the others.
_TO_NODES = np.cos(np.outer(_K, _ANGLES)) * np.where(_K == 0, 1, 2)[:, None] / NODES


def moments(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that the scores s of rows x lie in, and for each the (node, moment) sums of 1, x and the upper half of x x^T."""
    at = np.floor(s / SPAN).astype(np.int64)
    share = np.cos(np.outer(np.arccos(np.clip(2 * (s / SPAN - at) - 1, -1, 1)), _K)) @ _TO_NODES
    i, j = np.triu_indices(x.shape[1])
    terms = np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)
    found, of = np.unique(at, return_inverse=True)
    order = np.argsort(of, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(of, minlength=len(found)))[:-1])
    return found, np.stack([share[p].T @ terms[p] for p in parts])


def over_pairs(at: list[np.ndarray], sums: list[np.ndarray], w: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, slope and second derivatives over all pairs, from the scores of nodes and their moments: bad ones, good ones."""
    d = len(w)
    bad, good = sums
    loss, grad, cross = 0.0, np.zeros(d), np.zeros((d, d))
    second = np.zeros(bad.shape[1] - 1 - d)
    for lo in range(0, len(good), 1024):
        g, gap = good[lo : lo + 1024], at[1][lo : lo + 1024, None] - at[0]
        e = np.exp(-np.abs(gap))
        p, q = np.where(gap > 0, e, 1) / (1 + e), np.where(gap > 0, 1, e) / (1 + e)
        loss += g[:, 0] @ (np.log1p(e) + np.maximum(0, -gap)) @ bad[:, 0]
        grad += (g[:, 0] @ p) @ bad[:, 1 : d + 1] - (p @ bad[:, 0]) @ g[:, 1 : d + 1]
        h = p * q
        second += (h @ bad[:, 0]) @ g[:, d + 1 :] + (g[:, 0] @ h) @ bad[:, d + 1 :]
        cross += g[:, 1 : d + 1].T @ h @ bad[:, 1 : d + 1]
    hess = np.zeros((d, d))
    hess[np.triu_indices(d)] = second
    hess += np.triu(hess, 1).T
    return float(loss + ridge / 2 * w @ w), grad + ridge * w, hess - cross - cross.T + ridge * np.eye(d)


def fit_pairs(rows: DataFrame, mean: dict[str, float], scale: dict[str, float]) -> np.ndarray:
    """Weights of the standardized FEATURES under which the loss over all pairs of rows (y, FEATURES) is least.

    Each Newton step is a pass over rows; what comes to the driver are sums by label, interval of scores and node, as
    many as the scores are wide, however many rows there are.
    """
    m, s = np.array([mean[c] for c in FEATURES]), np.array([scale[c] for c in FEATURES])
    names = [f"m{i}" for i in range(1 + len(FEATURES) + len(FEATURES) * (len(FEATURES) + 1) // 2)]

    def measure(w):
        def run(batches):
            total = {}
            for batch in batches:
                y = batch.column(0).to_numpy()
                x = (np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1) - m) / s
                for k in np.unique(y).tolist():
                    for at, part in zip(*moments(x[y == k], x[y == k] @ w), strict=True):
                        total[k, at] = total[k, at] + part if (k, at) in total else part
            keys = [(k, int(at), i) for k, at in total for i in range(NODES)]
            sums = np.concatenate(list(total.values())) if total else np.zeros((0, len(names)))
            ids = [pa.array([x[c] for x in keys], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c) for c in sums.T)], ["y", "at", "node", *names])

        parts = rows.select("y", *FEATURES).mapInArrow(run, "y int, at long, node int, " + ", ".join(f"{c} double" for c in names))
        got = parts.groupBy("y", "at", "node").agg(*(F.sum(c).alias(c) for c in names)).toArrow().sort_by([("y", "ascending"), ("at", "ascending"), ("node", "ascending")])
        y, sums = got["y"].to_numpy(), np.stack([got[c].to_numpy() for c in names], axis=1)
        place = SPAN * (got["at"].to_numpy() + (np.cos(_ANGLES)[got["node"].to_numpy()] + 1) / 2)
        return over_pairs([place[y == k] for k in (0, 1)], [sums[y == k] for k in (0, 1)], w)

    return newton(measure, len(FEATURES))


def best_cut(rows: DataFrame, ws: Workspace) -> float:
    """The cut of rows (y, s) that leaves the fewest 1s below and 0s above it, of all cuts; the middle one of several.

    Equal scores stay together, and so do those that differ by 1e-9 or less. Ranges of scores are summed up each in a
    task of its own.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = rows.groupBy("s").agg(F.sum(2 * F.col("y") - 1).alias("more"))
    kinds = ws.save(kinds.repartitionByRange(parts, "s").withColumn("_span", F.spark_partition_id()).withColumn("all", F.lit(0)))
    summed = scan(kinds, None, ["s"], "all", upto=running_sum(F.col("more")), under=neighbour(F.col("s")))
    cuts = summed.where("under is null or s - under > 1e-9").select("all", "_span", "s", "under", (F.col("upto") - F.col("more")).alias("errors"))
    top = kinds.agg(F.max("_span").alias("_span"), F.max("s").alias("under"), F.sum("more").alias("errors"))
    cuts = ws.save(cuts.unionByName(top.select(F.lit(0).alias("all"), (F.col("_span") + 1).alias("_span"), F.lit(None).cast("double").alias("s"), "under", "errors")))
    least = cuts.groupBy("errors").agg(F.count("*").alias("n")).orderBy("errors").first()
    best = scan(cuts.where(F.col("errors") == least.errors), None, ["s"], "all", place=running_count())
    cut = best.where(F.col("place") == least.n // 2 + 1).first()
    for t in (kinds, cuts):
        ws.drop(t)
    if cut.s is None or cut.under is None:
        return cut.under + 1 if cut.s is None else cut.s - 1
    return (cut.under + cut.s) / 2


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, rank_score, and the COUNTS of every row of docs.

    rank_score is the Bradley-Terry score; the threshold is that quantile of it among the learned-from
    rows which splits their labels best, and score is the logistic of the distance from it, so 0.5 at
    the threshold. Labels are learned from rows of other folds only, from all of them and all their pairs. Null
    and empty texts are scored by their zero counts. Without labels of both kinds all scores are 0.5.
    Rows of equal score are called alike, as the cut never falls between them; repeated and null ids are
    scored as often as they come, null ones never learned from, repeated ones learned from once: of several
    labels the least, of several texts that of least features. Labels other than 0 and 1 aren't learned from.
    Texts are counted whole; columns of docs other than doc_id and text aren't read, whatever their names.
    """
    ws = Workspace(docs.sparkSession)
    counts = ws.save(text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"))
    table = counts.select("doc_id", *COUNTS, *feature_columns())
    spread = table.agg(*(F.avg(c).alias(f"m_{c}") for c in FEATURES), *(F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES)).first()
    mean = {c: spread[f"m_{c}"] or 0.0 for c in FEATURES}
    scale = {c: max(spread[f"s_{c}"] or 0.0, 1e-6) for c in FEATURES}
    marks = labels.where(~held_out(F.col("doc_id"), folds, fold)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    known = table.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"))
    rows = ws.save(known.join(marks, "doc_id").select("y", "x.*"))
    tau, total = 0.0, F.lit(0.0)
    if rows.select("y").distinct().count() == 2:
        for c, w in zip(FEATURES, fit_pairs(rows, mean, scale), strict=True):
            total = total + F.lit(float(w)) * (F.col(c) - mean[c]) / scale[c]
        tau = best_cut(rows.select("y", total.alias("s")), ws)
    ws.drop(rows)
    scored = table.withColumn("rank_score", total)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("rank_score") - tau))))
    scored = scored.withColumn("score", score)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rank_score", *COUNTS)
