"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all words, by a block-max index of the examples."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, text_chunks, word_hashes
from .workspace import Workspace

#: Most labelled documents that are read as examples, half of them of each label. Search costs grow with it.
SAMPLE = 4_000
#: Weight of a word that says nothing of the label, as a factor of its IDF, and how many standard errors
#: are taken off the distance of a word's log odds that is added to it. Every word of the examples counts.
FLOOR, ERRORS = 0.1, 2.0
NEIGHBOURS, BLOCK = 15, 64
#: A neighbour's vote counts by this power of its cosine; as many votes of average rows, in proportion to all
#: labels, are added to those of the neighbours, so that near neighbours of one label say more than far ones.
POWER, PRIOR = 2, 1.0
#: The most frequent terms of the examples are held as a dense matrix, the others as posting lists.
HEAD = 256


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def labelled_sample(labels: DataFrame, label: str, learn: Column, size: int) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample (doc_id, y), half of each label by order of a hash, and the rows each stands for."""
    rows = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropDuplicates(["doc_id"])
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2) for y in (0, 1)]
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = {y: max(1.0, totals.get(y, 0) / (size // 2)) for y in (0, 1)}
    return parts[0].union(parts[1]), weight


def word_counts(texts: pa.Array):
    """(row, word hashes, counts) of each text."""
    for lo, hi, data, offsets in text_chunks(texts):
        _, _, words, first = word_hashes(LOWER[data], offsets, ALNUM)
        for d in range(hi - lo):
            yield lo + d, *np.unique(words[first[d] : first[d + 1]], return_counts=True)


def found_in(vocab: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted vocab of those words that it has, and which these are."""
    if not len(vocab):
        return np.zeros(0, np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
    ok = vocab[at] == words
    return at[ok], ok


class Index:
    """Distinct unit vectors of the examples: the most frequent terms as blocks of a matrix with the greatest
    impact of each term in each block of examples, all other terms as posting lists."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], pos: np.ndarray, neg: np.ndarray, example: np.ndarray, prior: tuple[float, float] = (PRIOR / 2, PRIOR / 2)):
        self.idf, self.pos, self.neg, self.example, self.vectors, self.prior = idf, pos, neg, example, vectors, prior
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        impact = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        often = np.argsort(-np.bincount(terms, minlength=len(idf)), kind="stable")[:HEAD]
        self.column = np.full(len(idf), -1)
        self.column[often] = np.arange(len(often))
        at = self.column[terms]
        dense = np.zeros((self.blocks * BLOCK, len(often)))
        dense[doc[at >= 0], at[at >= 0]] = impact[at >= 0]
        self.dense = dense.reshape(self.blocks, BLOCK, -1)
        self.most = self.dense.max(axis=1).T
        terms, doc, impact = terms[at < 0], doc[at < 0], impact[at < 0]
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order].astype(np.int32), impact[order]
        self.first = np.searchsorted(terms[order], np.arange(len(idf) + 1))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (ties to the lower number) and the cosines, all above 0.

        Posting lists are summed in full; blocks of frequent terms are scored in descending order of their
        bounds, until no bound reaches the k-th cosine.
        """
        at = self.column[terms]
        q = np.zeros(self.dense.shape[2])
        q[at[at >= 0]] = weights[at >= 0]
        terms, weights = terms[at < 0], weights[at < 0]
        lo, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        post = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rare = np.bincount(self.doc[post], self.impact[post] * np.repeat(weights, n), self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bounds = q @ self.most + rare.max(axis=1)
        order = np.argsort(-bounds, kind="stable")
        best_doc, best = np.zeros(0, np.int64), np.zeros(0)
        lo, step = 0, 4
        while lo < len(order):
            group = order[lo : lo + step]
            group = group[bounds[group] > 0]
            if len(best) >= k:
                group = group[bounds[group] >= best[-1] - 1e-12]
            if not len(group):
                break
            value = np.concatenate([best, *(self.dense[b] @ q + rare[b] for b in group.tolist())])
            doc = np.concatenate([best_doc, (group[:, None] * BLOCK + np.arange(BLOCK)).ravel()])
            keep = np.flatnonzero(value > 0)
            if len(keep) > k:  # all that may tie with the k-th stay
                keep = keep[value[keep] >= np.partition(value[keep], len(keep) - k)[len(keep) - k] - 1e-11]
            doc, value = doc[keep], value[keep]
            top = np.lexsort((doc, -np.round(value, 12)))[:k]
            best_doc, best = doc[top], value[top]
            lo, step = lo + step, min(2 * step, 64)
        return best_doc, best

    def vote(self, docs: np.ndarray, cosines: np.ndarray, leave: int | None = None) -> float:
        """Log ratio of the votes for label 1 to those for 0, each neighbour's weighed by cosine**POWER and the
        rows it stands for, the prior's added."""
        pos, neg = self.pos[docs].copy(), self.neg[docs].copy()
        if leave is not None:
            own = docs == leave
            pos[own], neg[own] = 0, 0
        w = cosines**POWER
        return float(np.log(((w * pos).sum() + self.prior[0]) / ((w * neg).sum() + self.prior[1])))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through votes, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p)
        grad = np.array([(g * x).sum() + 0.1 * (a - 1), g.sum() + 0.01 * b])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def word_weights(n1: np.ndarray, n0: np.ndarray, most1: int, most0: int, df: np.ndarray, total: int) -> np.ndarray:
    """IDF of words times how surely their log odds differ between the n1 of most1 and n0 of most0 examples with them."""
    odds = np.log((n1 + 0.5) / (most1 - n1 + 0.5)) - np.log((n0 + 0.5) / (most0 - n0 + 0.5))
    error = np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    return (np.log((1 + total) / (1 + df)) + 1) * (FLOOR + np.maximum(0, np.abs(odds) - ERRORS * error))


class Model:
    """The words of the examples, their weights, and the examples as flat arrays; tasks make the index of it once."""

    def __init__(self, vocab, weights, terms, counts, first, pos, neg, example, prior):
        self.vocab, self.weights, self.prior, self.flat = vocab, weights, prior, (terms, counts, first, pos, neg, example)
        self.made = None

    def index(self) -> Index:
        if self.made is None:
            terms, counts, first, pos, neg, example = self.flat
            w = (1 + np.log(counts)) * self.weights[terms]
            w /= np.repeat(np.sqrt(np.add.reduceat(w * w, first[:-1])), np.diff(first)) if len(w) else 1
            # examples that lean on the same frequent terms share blocks, so that bounds are tight
            often = np.bincount(terms, minlength=len(self.weights))[terms] if len(terms) else terms
            kind = [int(terms[a:z][np.argmax(w[a:z] * (often[a:z] * 50 > len(pos)))]) for a, z in zip(first[:-1], first[1:], strict=True)]
            order = np.argsort(np.array(kind, np.int64), kind="stable")
            self.made = Index(self.weights, [(terms[first[i] : first[i + 1]], w[first[i] : first[i + 1]]) for i in order], pos[order], neg[order], example[order], self.prior)
            self.flat = None
        return self.made

    def __getstate__(self):
        return {"vocab": self.vocab, "weights": self.weights, "prior": self.prior, "flat": self.flat, "made": None}


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, ws: Workspace, size: int = SAMPLE):
    """(broadcast model, slope, intercept, rate of wordless texts) learned from labels in `learn`.

    How many documents have a word is counted over all of docs, for every word of the examples. What comes
    to the driver is the sample: its vectors, its words and its votes.
    """
    spark = docs.sparkSession
    sample, stands = labelled_sample(labels, label, learn, size)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = texts.join(F.broadcast(ws.save(sample)), "doc_id")  # at most `size` ids

    def counted(batches):
        for batch in batches:
            found = [(w, c) for _, w, c in word_counts(batch.column("text"))]
            ends = pa.array(np.cumsum([0, *(len(w) for w, _ in found)]), pa.int32())
            words = np.concatenate([w for w, _ in found]).view(np.int64) if found else np.zeros(0, np.int64)
            counts = np.concatenate([c for _, c in found]).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (words, counts))], ["doc_id", "y", "words", "counts"])

    read = ws.save(texts.mapInArrow(counted, "doc_id long, y int, words array<long>, counts array<int>").dropDuplicates(["doc_id"]))
    n = {r.y: r.n for r in read.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    bare = {r.y: r.n for r in read.where(F.size("words") == 0).groupBy("y").agg(F.count("*").alias("n")).collect()}
    # wordless texts: those of the sample, and one more text at the rate of all labels
    share = [(1.0 + m) * stands[y] for y, m in ((0, n0), (1, n1))]
    loose = [bare.get(y, 0) * stands[y] + share[y] / sum(share) for y in (0, 1)]

    terms = read.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).toArrow()
    vocab = terms["w"].to_numpy().view(np.uint64)
    order = np.argsort(vocab)
    vocab, with1, with0 = vocab[order], terms["n1"].to_numpy()[order], terms["n0"].to_numpy()[order]
    known = spark.sparkContext.broadcast(vocab)

    def presence(batches):
        vocab, seen = known.value, None
        for batch in batches:
            seen = np.zeros(len(vocab), np.int64) if seen is None else seen
            for _, w, _ in word_counts(batch.column(0)):
                seen[found_in(vocab, w)[0]] += 1
        at = np.flatnonzero(seen) if seen is not None else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at] if len(at) else np.zeros(0, np.int64))], ["at", "n"])

    counted_all = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(presence, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocab))
    df[counted_all["at"].to_numpy()] = counted_all["n"].to_numpy()
    weights = word_weights(with1, with0, n1, n0, df, docs.count())

    kinds = read.where(F.size("words") > 0).groupBy("words", "counts").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"), F.min("doc_id").alias("doc_id")).toArrow().combine_chunks()
    kinds = kinds.take(pa.compute.sort_indices(kinds["doc_id"])).combine_chunks()
    lists = [kinds[c].chunk(0) if len(kinds) else pa.array([], pa.list_(pa.int64())) for c in ("words", "counts")]
    first = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())]).astype(np.int64)
    at = np.searchsorted(vocab, lists[0].flatten().to_numpy().view(np.uint64)).astype(np.int32)
    mass = PRIOR * (n0 * stands[0] + n1 * stands[1]) / max(1, n0 + n1)
    prior = ((mass or PRIOR) * share[1] / sum(share), (mass or PRIOR) * share[0] / sum(share))
    pos, neg = kinds["n1"].to_numpy() * stands[1], kinds["n0"].to_numpy() * stands[0]
    model = spark.sparkContext.broadcast(Model(vocab, weights, at, lists[1].flatten().to_numpy().astype(np.int32), first, pos, neg, kinds["doc_id"].to_numpy(), prior))

    def votes(batches):
        index = model.value.index()
        for batch in batches:
            x = []
            for i in batch.column(0).to_pylist():  # each kind votes on itself without its own rows
                v = index.vote(*index.nearest(*index.vectors[i], NEIGHBOURS + 1), leave=i)
                x.append((v, float(index.pos[i]), float(index.neg[i])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in x], pa.float64()) for c in range(3)], ["x", "pos", "neg"])

    x = y = weight = np.zeros(0)
    if len(kinds):
        parts = max(1, min(spark.sparkContext.defaultParallelism * 4, len(kinds) // 64))
        voted = spark.range(0, len(kinds), 1, parts).mapInArrow(votes, "x double, pos double, neg double").toArrow().sort_by([("x", "ascending"), ("pos", "ascending"), ("neg", "ascending")])
        x, y = np.tile(voted["x"].to_numpy(), 2), np.repeat([1, 0], len(voted))
        weight = np.concatenate([voted["pos"].to_numpy(), voted["neg"].to_numpy()])
        x, y, weight = x[weight > 0], y[weight > 0], weight[weight > 0]
    slope, intercept = platt(x, y, weight) if len(set(y.tolist())) == 2 else (1.0, 0.0)
    return model, slope, intercept, loose[1] / sum(loose)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, size: int = SAMPLE, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples: doc_id, cosine) of every row of docs.

    Labels are learned from rows of other folds only: a bounded sample of `size` of them, which also are
    the examples. The space of vectors is that of all words of the examples, none left out; words that no
    example has have no place in it. A text that shares no word with an example, null and empty ones too,
    gets the rate of wordless texts. Examples of equal vectors are one neighbour that stands for all of
    them, so ties aren't cut. Without labels of both kinds the votes are
    not calibrated: scores are the votes' share with the prior. Null ids are never
    held out and never learned from; repeated rows are scored as often as they come. Other columns of docs
    and labels aren't read, whatever their names.
    """
    ws = Workspace(docs.sparkSession)
    model, slope, intercept, rate = fit(docs, labels, label, ~held_out(F.col("doc_id"), folds, fold), ws, size)

    def run(batches):
        vocab, index, known = model.value.vocab, model.value.index(), {}
        for batch in batches:
            score, near = np.full(len(batch), rate), [None] * len(batch)
            for d, words, counts in word_counts(batch.column("text")):
                t, ok = found_in(vocab, words)
                if not len(t):
                    continue
                c = counts[ok]
                key = blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest()
                if key not in known:
                    if len(known) >= 50_000:
                        known.clear()
                    found, cosine = index.nearest(t, index.unit(t, c), k)
                    v = index.vote(found, cosine)
                    p = float(1 / (1 + np.exp(-np.clip(slope * v + intercept, -30, 30))))
                    known[key] = p, [{"doc_id": int(index.example[i]), "cosine": float(x)} for i, x in zip(found[:3], cosine[:3], strict=True)]
                score[d], near[d] = known[key]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(near, kind)], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double>>")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id"), folds, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
