"""Robust multivariate outliers: a minimum-covariance-determinant estimate for each language and source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import text_counts
from .workspace import Workspace

#: Rates of counts, shrunk by PRIOR words and offset, so that a single mark in a short text weighs little.
#: Duplicate lines are a share of lines, shrunk by LINES: one repeated heading weighs little, a page of them much.
PRIOR, LINES, OFFSET = 30.0, 5.0, 0.05
#: Least standard deviation of each statistic: most texts have no symbol, so their spread there is none.
#: It is wider for repeats, since a heading or notice found twice is common in sound short texts.
FLOORS = [0.1, 0.1, 0.5, 0.4, 0.1, 0.1]
RATES = ["n_symbols", "n_repeat_words", "n_dup_lines", "n_upper", "n_stutter"]
NAMES = ["word_length", *(f"f_{c}" for c in RATES)]
D = len(NAMES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
#: A language's estimate counts as this many rows of each of its sources, everything's as much of each language.
SHARED = 30.0
#: Rows of a pool that starts are searched in, random starts, and candidates that go on to all rows.
SEARCHED, STARTS, CANDIDATES = 500, 30, 2
#: A candidate has converged where a step lowers the log determinant by less. Each other step lowers it by at
#: least as much and FLOORS bound it from below, so steps come to an end without a cap.
SETTLED = 1e-3
MODEL = "pool string, start int, mu array<double>, scatter array<double>, precision array<double>, logdet double"


def few_tasks(df: DataFrame) -> DataFrame:
    """Tables of a row or two to each pool in as many tasks as there are cores, not in one to each shuffle partition."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def features() -> list[Column]:
    rate = lambda c: F.col(c) / (F.col("n_lines") + LINES if c == "n_dup_lines" else F.col("n_words") + PRIOR)
    out = [F.log((F.col("word_chars") + 5 * PRIOR) / (F.col("n_words") + PRIOR)).alias("word_length")]
    return out + [F.log(OFFSET + rate(c)).alias(f"f_{c}") for c in RATES]


def joint(n: float, mean: np.ndarray, cov: np.ndarray, mu0: np.ndarray, t0: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter of n rows together with SHARED rows of mean mu0 and scatter t0."""
    mu = (SHARED * mu0 + n * mean) / (SHARED + n)
    a, b = mu0 - mu, mean - mu
    return mu, (SHARED * (t0 + np.outer(a, a)) + n * (factor * cov + np.outer(b, b))) / (SHARED + n)


def logdet(scatter: np.ndarray) -> float:
    return float(np.linalg.slogdet(scatter + np.diag(np.square(FLOORS)))[1])


def concentrated(x: np.ndarray, mu: np.ndarray, scatter: np.ndarray, share: float, mu0: np.ndarray, t0: np.ndarray):
    """One concentration step: the share of rows nearest by (mu, scatter), ties included, give the next ones."""
    c = x - mu
    d2 = np.einsum("ij,jk,ik->i", c, np.linalg.inv(scatter + np.diag(np.square(FLOORS))), c)
    near = x[d2 <= np.sort(d2)[int(np.ceil(share * len(x))) - 1]]
    return joint(len(near), near.mean(axis=0), np.cov(near.T, bias=True).reshape(D, D), mu0, t0)


def settle(x: np.ndarray, mu: np.ndarray, scatter: np.ndarray, share: float, mu0: np.ndarray, t0: np.ndarray, steps: int = 50):
    """Concentration steps until the determinant doesn't fall any more: (log determinant, mu, scatter)."""
    best = np.inf
    for _ in range(steps):
        mu, scatter = concentrated(x, mu, scatter, share, mu0, t0)
        now = logdet(scatter)
        if best - now < 1e-9:
            break
        best = now
    return now, mu, scatter


def searched(x: np.ndarray, share: float, mu0: np.ndarray, t0: np.ndarray, starts: int, seed: int):
    """The best distinct candidates: from the shared estimate and from random sets of D + 1 rows, two steps
    each, the best few of them to the end."""
    rng = np.random.default_rng(seed)
    tried = [concentrated(x, mu0, t0, share, mu0, t0)]
    for _ in range(starts):
        few = x[rng.permutation(len(x))[: D + 1]]
        tried.append(joint(len(few), few.mean(axis=0), np.cov(few.T, bias=True).reshape(D, D), mu0, t0))
    tried = [concentrated(x, mu, t, share, mu0, t0) for mu, t in (concentrated(x, *m, share, mu0, t0) for m in tried)]
    tried.sort(key=lambda m: logdet(m[1]))
    out = []
    for found in sorted((settle(x, *m, share, mu0, t0) for m in tried[:5]), key=lambda m: m[0]):
        if len(out) < CANDIDATES and all(abs(found[0] - o[0]) > 1e-6 for o in out):
            out.append(found)
    return out


def starting(good: DataFrame, prior: DataFrame, share: float) -> DataFrame:
    """MODEL rows: a few candidates for each pool, found in SEARCHED of its rows, those of least hash."""
    order = F.xxhash64("doc_id", *NAMES)
    few = good.withColumn("_h", order).withColumn("_r", F.row_number().over(Window.partitionBy("pool").orderBy("_h"))).where(F.col("_r") <= SEARCHED)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_h")
        mu0, t0 = np.array(t["mu0"].iloc[0]), np.array(t["t0"].iloc[0]).reshape(D, D)
        found = searched(t[NAMES].to_numpy(float), share, mu0, t0, STARTS, 7)
        return pd.DataFrame([model_row(t["pool"].iloc[0], i, mu, scatter) for i, (_, mu, scatter) in enumerate(found)], columns=[f.split()[0] for f in MODEL.split(", ")])

    return few_tasks(few.select("pool", "_h", *NAMES).join(prior, "pool").groupBy("pool").applyInPandas(one, MODEL))


def model_row(pool: str, start: int, mu: np.ndarray, scatter: np.ndarray) -> tuple:
    inverse = np.linalg.inv(scatter + np.diag(np.square(FLOORS)))
    return pool, start, mu.tolist(), scatter.reshape(-1).tolist(), inverse.reshape(-1).tolist(), logdet(scatter)


def moments(df: DataFrame) -> DataFrame:
    sums = df.groupBy("pool", "start").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(NAMES)), *(F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}_{j}") for i, j in PAIRS))
    return few_tasks(sums)


def model(table: DataFrame, prior: DataFrame, factor: float = 1.0) -> DataFrame:
    """MODEL of each row of moments together with its pool's prior."""

    def run(frames):
        for t in frames:
            rows = []
            for r in t.to_dict("records"):
                cov = np.zeros((D, D))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
                mean = np.array([r[f"m{i}"] for i in range(D)])
                rows.append(model_row(r["pool"], r["start"], *joint(r["n"], mean, cov, np.array(r["mu0"]), np.array(r["t0"]).reshape(D, D), factor)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in MODEL.split(", ")])

    return table.join(prior, "pool").mapInPandas(run, MODEL)


def innermost(near: DataFrame, share: float, ws: Workspace) -> DataFrame:
    """The share of each pool's rows of least d2; ties at its edge are all taken in. The edges, a row to each
    candidate, are saved: being of known size they are joined without gathering a pool in one task."""
    edge = ws.save(few_tasks(near.groupBy("pool", "start").agg(F.percentile_approx("d2", share, 10_000).alias("edge"))))
    return near.join(edge, ["pool", "start"]).where("d2 <= edge")


def least_determinant(good: DataFrame, prior: DataFrame, share: float, ws: Workspace) -> DataFrame:
    """The minimum-covariance-determinant estimate of every pool of good (pool, NAMES): MODEL, one row each.

    prior has (pool, mu0, t0): an estimate that counts as SHARED further rows of the pool. Candidates
    found in a part of each pool take concentration steps over all its rows until they settle; the one of
    least determinant is kept, and its scatter made consistent for normal rows. The determinant over a part
    is no measure for one over all rows, so each candidate takes two steps at least.
    """
    settled = None
    going = ws.save(starting(good, prior, share).withColumn("logdet", F.lit(float("inf"))))
    while not going.isEmpty():
        near = distance(good, going.select("pool", "start", "mu", "precision"), "inner")
        new = model(moments(innermost(near, share, ws)), prior).join(going.select("pool", "start", F.col("logdet").alias("before")), ["pool", "start"])
        new = ws.save(new.withColumn("done", F.col("before") - F.col("logdet") < SETTLED).drop("before"))
        done, going = new.where("done").drop("done"), new.where("not done").drop("done")
        settled = done if settled is None else settled.unionByName(done)
    if settled is None:
        return going
    best = ws.save(few_tasks(settled.groupBy("pool").agg(F.min_by(F.struct("start", "mu", "precision"), F.struct("logdet", "start")).alias("m"))).select("pool", "m.*"))
    return ws.save(model(moments(innermost(distance(good, best, "inner"), share, ws)), prior, consistency(share)))


def chi2_quantile(p: float, d: int) -> float:
    """By the Wilson-Hilferty approximation."""
    lo, hi = -10.0, 10.0
    from math import erf

    for _ in range(80):
        z = (lo + hi) / 2
        lo, hi = (z, hi) if 0.5 * (1 + erf(z / 2**0.5)) < p else (lo, z)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def consistency(share: float) -> float:
    """Scales the scatter of the innermost `share` of a normal sample to that of all of it."""
    q = chi2_quantile(share, D)
    rng = np.random.default_rng(0)
    x = rng.chisquare(D + 2, 200_000)
    return share / float((x <= q).mean())


def distance(df: DataFrame, fitted: DataFrame, how: str = "left") -> DataFrame:
    """Adds the squared Mahalanobis distance d2 of each row from its pool's models."""
    centred = df.join(fitted, "pool", how).withColumns({f"x{i}": F.col(c) - F.col("mu")[i] for i, c in enumerate(NAMES)})
    terms = [F.col("precision")[i * D + j] * F.col(f"x{i}") * F.col(f"x{j}") * (1.0 if i == j else 2.0) for i, j in PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return centred.withColumn("d2", total).drop("mu", "precision", *(f"x{i}" for i in range(D)))


def pooled(df: DataFrame) -> DataFrame:
    """Adds by_lang and pool (language and source); nulls are names of their own."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    return df.withColumns({"by_lang": name("lang"), "pool": F.concat(name("lang"), F.lit("\u0001"), name("source"))})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    return text_counts(docs, *keep).select("*", *features(), base_failed().alias("base_failed"))


def everything(good: DataFrame, ws: Workspace) -> DataFrame:
    """One row (mu0, t0): coordinate medians and squared median deviations of all rows."""
    mid = ws.save(good.agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"q{i}") for i, c in enumerate(NAMES))))
    spread = good.crossJoin(F.broadcast(mid)).agg(*(F.first(f"q{i}").alias(f"q{i}") for i in range(D)), *(F.percentile_approx(F.abs(F.col(c) - F.col(f"q{i}")), 0.5, 1000).alias(f"s{i}") for i, c in enumerate(NAMES)))
    t0 = [(1.4826 * F.col(f"s{i}")) ** 2 if i == j else F.lit(0.0) for i in range(D) for j in range(D)]
    return ws.save(spread.where("q0 is not null").select(F.array(*(F.col(f"q{i}") for i in range(D))).alias("mu0"), F.array(*t0).alias("t0")))


def quality_rules(docs: DataFrame, share: float = 0.75, tail: float = 1e-6, carry: bool = False) -> DataFrame:
    """doc_id, lang, source, the counts, d2, base_failed, kept of every row of docs; with carry, docs' own
    columns of the rows that are kept.

    Each language and source has its own minimum-covariance-determinant estimate, over the `share` of its
    rows of least determinant; its language's estimate counts as SHARED further rows of it, so sources of
    few rows lean on their language by weight, whatever their size. Rows that fail the base rules take no
    part; where all rows of a pool fail them, nothing is left to judge. A row is rejected where d2 exceeds
    the chi-square quantile of 1 - tail. Null texts have no words and fail the base rules; null languages
    and sources are values of their own. Repeated rows count as often as they come; ties at the share's
    edge are all taken in. Texts of any length are counted whole.
    """
    ws = Workspace(docs.sparkSession)
    stats = ws.save(pooled(measured(docs, "doc_id", "lang", "source")))
    good = stats.where("not base_failed").select("doc_id", "by_lang", "pool", *NAMES)
    langs = good.select("doc_id", F.col("by_lang").alias("pool"), *NAMES)
    prior = ws.save(few_tasks(langs.select("pool").distinct()).crossJoin(F.broadcast(everything(good, ws))))
    by_lang = least_determinant(langs, prior, share, ws)
    prior = few_tasks(good.select("pool", "by_lang").distinct()).join(by_lang.select(F.col("pool").alias("by_lang"), F.col("mu").alias("mu0"), F.col("scatter").alias("t0")), "by_lang")
    fitted = least_determinant(good, ws.save(prior.select("pool", "mu0", "t0")), share, ws).select("pool", "mu", "precision")
    limit = chi2_quantile(1 - tail, D)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)
    if carry:
        own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
        rows = docs.select("*", *(F.col(c).alias(v) for c, v in own.items())).select(*own.values(), "lang", "source", "text")
        rows = distance(pooled(measured(rows, *own.values(), "lang", "source")), fitted).where(kept)
        return rows.select(*(F.col(v).alias(c) for c, v in own.items()))
    return distance(stats, fitted).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "d2", "base_failed", kept.alias("kept"))
