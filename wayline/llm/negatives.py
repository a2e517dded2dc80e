"""Hard negatives by blocked dense matrix products: anchor blocks, broadcast, against candidate blocks.

Scores are inner products of whole numbers in float64, exact below 2**53; pairs that could reach more are
multiplied as Python integers. Each task keeps the best few rows per anchor and hands on only those, so what
is shuffled is (tasks x anchors x k) rows, merged by a window; no score of another pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace

#: Bytes of one broadcast block of anchors (as float64), and cells of one product.
BLOCK_BYTES, CELLS = 32 << 20, 1 << 21
EXACT = 2.0**53
LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, q (array of double: floor(scale * x), x as double) of the rows that take part."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), values.alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    # floor of a double stays a double, so that components beyond the long range are kept
    q = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(scale * x).cast("double")).otherwise(scale * x))
    return out.select("vec_id", "label", q.alias("q")).where(F.forall("q", lambda x: F.abs(x) < float("inf")))


class Block:
    """Anchors of one vector length: numbers, ids, labels and their matrix."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.number, self.ids, self.labels, self.matrix = number, ids, labels, matrix
        self.most = float(np.abs(matrix).max(initial=0.0))

    def part(self, lo: int, hi: int) -> Block:
        return Block(self.number[lo:hi], self.ids[lo:hi], self.labels[lo:hi], self.matrix[lo:hi])


def product(block: Block, candidates: np.ndarray) -> np.ndarray:
    """Inner products, exact: float64 where no partial sum can reach 2**53, else integers kept in the long range."""
    most = float(np.abs(candidates).max(initial=0.0))
    if block.most * most * max(1, candidates.shape[1]) < EXACT:
        return block.matrix @ candidates.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(block.matrix) @ whole(candidates).T, -LONG, LONG)


def blocks_of(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of candidates of one vector length, by ascending id, in blocks of at most `cells` components."""
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        size, flat = pc.list_value_length(batch.column(2)).to_numpy(), batch.column(2).flatten().to_numpy()
        first = np.cumsum(size) - size
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            own = own[np.argsort(ids[own], kind="stable")]
            step = max(1, cells // max(dim, 1))
            for lo in range(0, len(own), step):
                at = own[lo : lo + step]
                yield ids[at], labels[at], flat[first[at][:, None] + np.arange(dim)]


class Best:
    """The first k entries of each slot by descending score, ties by ascending id, merged as they come."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(slots, -np.inf)  # the k-th score so far

    def add(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores and allowed: one row for each of slots, one column for each of ids."""
        masked = np.where(allowed, scores, -np.inf).astype(float)  # rounded beyond 2**53, so only a first sieve
        floor = self.least[slots]
        if masked.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(masked, masked.shape[1] - self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(allowed & (masked >= floor[:, None]))
        if not len(row):
            return
        slot, score, id_ = (np.concatenate([a, b]) for a, b in ((self.slot, slots[row]), (self.score, scores[row, col].astype(np.int64)), (self.id, ids[col])))
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.slot, self.score, self.id)], names)


def merged(partial: DataFrame, slot: str, score: str, id_: str, k: int) -> DataFrame:
    """The first k of each slot over all tasks, with their rank from 1."""
    w = Window.partitionBy(slot).orderBy(F.desc(score), id_)
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def anchor_blocks(anchors: DataFrame) -> Iterator[list[Block]]:
    """Blocks of anchors for the driver, each at most BLOCK_BYTES, in order of id; one is held at a time."""
    bounds = anchors.agg(F.count("*").alias("n"), F.sum(F.size("q").cast("long") * 8 + 24).alias("bytes"), F.max(F.size("q").cast("long") * 8 + 24).alias("most")).first()
    if not bounds.n:
        return
    many = max(1, -(-2 * bounds.bytes // BLOCK_BYTES))  # dealt by hash: half full on average, checked below
    dealt = anchors.withColumn("_block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(many)))
    sizes = dealt.groupBy("_block").agg(F.sum(F.size("q").cast("long") * 8 + 24).alias("bytes"))
    if many > 1 and (big := sizes.agg(F.max("bytes")).first()[0]) > BLOCK_BYTES + bounds.most:
        raise ValueError(f"a block of anchors has {big} bytes")
    for b in range(many):
        t = (dealt.where(F.col("_block") == b) if many > 1 else dealt).select("vec_id", "label", "q").orderBy("vec_id", "label", "q").toArrow().combine_chunks()
        found, at = [], 0
        for ids, labels, matrix in blocks_of(iter(t.to_batches()), 1 << 62):
            found.append(Block(np.arange(at, at + len(ids)), ids, labels, matrix))
            at += len(ids)
        if at:
            yield found


def meet(candidates: DataFrame, blocks, add, best, names: list[str]) -> DataFrame:
    """Partial results of each task: every candidate block against every anchor block of the broadcast list."""

    def run(batches):
        top = best()
        for ids, labels, matrix in blocks_of(batches, CELLS // 4):
            for block in blocks.value:
                if block.matrix.shape[1] != matrix.shape[1]:
                    continue  # no inner product
                step = max(1, CELLS // len(ids))
                for lo in range(0, len(block.ids), step):
                    part = block.part(lo, lo + step)
                    add(top, part, product(part, matrix), ids, labels)
        yield top.batch(names)

    return candidates.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, embedding, label; anchor: which of them are anchors. An anchor's positives are the first
    `positives` other rows of its label, by descending score, ties by vec_id. For each, the first k rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Anchors are broadcast in blocks of bounded size, each in two passes over all rows: the positives, then the
    windows that they set. Rows without vec_id, label or vector, or with a null or non-finite component, take
    no part; vectors of another length never meet. Rows that share an anchor's vec_id aren't others to it; a
    row that comes twice counts twice, as anchor too. Scores beyond the long range stay at its bounds. An
    empty table gives no rows; other columns aren't read, whatever their names.
    """
    spark, ws = rows.sparkSession, Workspace(rows.sparkSession)
    marked = rows.select("vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    candidates = whole_vectors(marked, scale)
    anchors = whole_vectors(marked.where("_anchor"), scale)
    out = []
    for blocks in anchor_blocks(anchors):
        ids, n = np.concatenate([b.ids for b in blocks]), sum(len(b.ids) for b in blocks)
        sent = spark.sparkContext.broadcast(blocks)

        def add_positives(top, part, score, ids, labels):
            top.add(part.number, score, (part.labels[:, None] == labels) & (part.ids[:, None] != ids), ids)

        first = merged(meet(candidates, sent, add_positives, lambda n=n: Best(n, positives), ["number", "score", "id"]), "number", "score", "id", positives)
        found = first.orderBy("number", "rank").toArrow()  # at most `positives` rows for each anchor of the block
        number, score, id_ = (found[c].to_numpy() for c in ("number", "score", "id"))
        windows = spark.sparkContext.broadcast((number, score))

        def add_negatives(top, part, scores, ids, labels, windows=windows):
            number, bound = windows.value
            slots = np.flatnonzero((number >= part.number[0]) & (number <= part.number[-1])) if len(part.number) else np.zeros(0, np.int64)
            if not len(slots):
                return
            at = number[slots] - part.number[0]
            other = part.labels[:, None] != labels
            exact = np.abs(bound[slots]).max() < 2**52 and scores.dtype != object
            bounds, values = (bound[slots], scores.astype(np.int64) * 100) if exact else (bound[slots].astype(object), scores.astype(object) * 100)
            step = max(1, CELLS // len(ids))
            for lo in range(0, len(slots), step):
                own = slice(lo, lo + step)
                v, b = values[at[own]], bounds[own, None]
                inside = ((low * b <= v) & (v <= high * b)).astype(bool)
                top.add(slots[own], scores[at[own]], inside & other[at[own]], ids)

        partial = meet(candidates, sent, add_negatives, lambda n=len(number): Best(n, k), ["slot", "negative_score", "negative_id"])
        negatives = merged(partial, "slot", "negative_score", "negative_id", k)
        known = spark.createDataFrame(pa.table({"slot": np.arange(len(number)), "anchor_id": ids[number] if len(number) else np.zeros(0, np.int64), "positive_id": id_, "positive_score": score}))
        joined = negatives.join(F.broadcast(known), "slot")  # as many rows as positives above
        out.append(ws.save(joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")))
        windows.destroy()
        sent.destroy()
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


NEGATIVES_SQL = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM v),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
  FROM c a JOIN c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.q) = len(c.q)),
 p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
   s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""
