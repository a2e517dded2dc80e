"""Circulant MinHash near-duplicates: banding, exact Jaccard confirmation, connected components.

Steps, all distributed:
1. One pass over the texts makes each row's shingle-set size, a 128-bit key of its set, band keys and a
   256-bit sketch (four low bits of each coordinate). Rows with equal sets become one class.
2. Classes of a band are range-sorted by sketch; neighbours become candidate pairs, the best few of each
   class are confirmed on full sets, confirmed links are joined to components.
3. Bands that still hold several components are gathered by their main component. Inside such a cell
   every row outside the main component meets all rows of other components, block against block; a
   task reports links only, never the pairs it looked at. Pairs inside one component can't change the
   result and aren't looked at.
"""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import GOLD, LOWER, SPACED, mix, shingles, text_chunks, word_hashes
from .workspace import Workspace

COORDS, ROWS = 64, 4
#: A pair at the threshold may share no band, or have a sketch over the slack, with this probability at most.
MISS, OVER = 1e-5, 1.1e-5
SIGNATURE = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def layout(percent: int) -> tuple[int, int]:
    """Bands of 4 coordinates, and coordinates of the sketch's 64 that may differ, for a least Jaccard: 16 and 22 at
    85 (of a pair's coordinates 9 differ on average, with deviation 2.8), 22 and 27 at 80 (12 and 3.1)."""
    j = min(percent, 99) / 100
    bands = max(COORDS // ROWS, ceil(log(MISS) / log(1 - j**ROWS)))
    p = (1 - j) * 15 / 16
    over = lambda s: sum(comb(COORDS, i) * p**i * (1 - p) ** (COORDS - i) for i in range(s + 1, COORDS + 1))
    return bands, next(s for s in range(COORDS + 1) if over(s) <= OVER)


def sets_of(column: pa.Array, k: int):
    """Yields (row, sorted distinct shingle hashes) of each text; case of A-Z is folded."""
    for lo, hi, data, offsets in text_chunks(column):
        _, _, words, first = word_hashes(LOWER[data], offsets, SPACED)
        values, bounds = shingles(words, first, k)
        for d in range(hi - lo):
            yield lo + d, np.unique(values[bounds[d] : bounds[d + 1]])


def second(y: np.ndarray) -> np.ndarray:
    """The permutation whose shifts give the coordinates: a bijection of 64-bit values."""
    y *= np.uint64(0xFF51AFD7ED558CCD)
    y ^= y >> np.uint64(33)
    y *= np.uint64(0xC4CEB9FE1A85EC53)
    y ^= y >> np.uint64(29)
    return y


def circulant(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """Signatures of nonempty sets: the first permutation scatters items, the second one, shifted
    circularly by one more place for each coordinate, orders them; the least value is kept."""
    bounds = np.cumsum([0] + [len(s) for s in sets[:-1]])
    place = mix(np.concatenate(sets) + GOLD)
    out = np.empty((coords, len(sets)), np.uint64)
    for c in range(coords):
        out[c] = np.minimum.reduceat(second(place - np.uint64(c + 1)), bounds)
    return out


def signature_batches(k: int, count: int):
    def run(batches):
        for batch in batches:
            ids, rows, found = batch.column(0), [], []
            out = {c: [] for c in ("row", "n", "k1", "k2")}
            bands, planes = [], []

            def flush():
                if not found:
                    return
                sig = circulant(found, max(COORDS, count * ROWS))
                for b in range(count):
                    h = np.full(sig.shape[1], b + 1, np.uint64)
                    for r in range(ROWS):
                        h = mix(h * GOLD + sig[b * ROWS + r])
                    bands_part.append(h)
                for p in range(4):
                    bits = (sig[:COORDS] >> np.uint64(p)) & np.uint64(1)
                    planes_part.append((bits << np.arange(COORDS, dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64))

            for row, s in sets_of(batch.column(1), k):
                out["row"].append(row)
                out["n"].append(len(s))
                out["k1"].append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                out["k2"].append(int(mix(s * GOLD + np.uint64(1)).sum(dtype=np.uint64)) if len(s) else 0)
                if len(s):
                    rows.append(row)
                    found.append(s)
                if sum(map(len, found[-64:])) > 1 << 17 or len(found) >= 256:
                    bands_part, planes_part = [], []
                    flush()
                    bands.append(np.array(bands_part))
                    planes.append(np.array(planes_part))
                    found = []
            if found:
                bands_part, planes_part = [], []
                flush()
                bands.append(np.array(bands_part))
                planes.append(np.array(planes_part))
                found = []
            n = len(batch)
            band = np.zeros((n, count), np.uint64)
            plane = np.zeros((n, 4), np.uint64)
            if rows:
                band[rows] = np.concatenate(bands, axis=1).T
                plane[rows] = np.concatenate(planes, axis=1).T
            empty = np.ones(n, bool)
            empty[rows] = False
            sizes = np.where(empty, 0, count)
            nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(band[~empty].reshape(-1).view(np.int64)))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out["n"], pa.int64()), as_long(out["k1"]), as_long(out["k2"]), nested, *(as_long(plane[:, p].copy()) for p in range(4))],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "s0", "s1", "s2", "s3"],
            )

    return run


def signatures(docs: DataFrame, k: int = 5, count: int = COORDS // ROWS) -> DataFrame:
    """One row per document: set size, set key, band keys (none for an empty set), sketch."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(signature_batches(k, count), SIGNATURE)


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) of every node of edges (a, b): the least node reachable.

    Alternates linking larger neighbours to the least one (large star) and smaller ones (small star)
    until nothing changes; every step is a join and a combining aggregation.
    """
    star = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last, old = None, None
    while True:
        both = star.union(star.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low).where("u <> v").distinct()
        new = ws.save(small)
        ws.drop(star)
        star = new
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


def neighbours(rows, slack: int, width: int = 1):
    """Pairs of rows that follow each other in a band; rows come sorted by (band, sketch)."""

    def run(batches):
        keep = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([keep, batch]) if keep is not None else pa.Table.from_batches([batch])
            t = t.combine_chunks()
            key, node = t.column("band").to_numpy(), t.column("node").to_numpy()
            planes = [t.column(c).to_numpy() for c in ("s0", "s1", "s2", "s3")]
            a, b, off = [], [], []
            for w in range(1, width + 1):
                same = np.flatnonzero((key[w:] == key[:-w]) & (node[w:] != node[:-w]))
                x = np.zeros(len(same), np.int64)
                for p in planes:
                    x |= p[same] ^ p[same + w]
                d = np.bitwise_count(x.view(np.uint64)).astype(np.int32)
                ok = d <= slack
                a.append(np.minimum(node[same], node[same + w])[ok])
                b.append(np.maximum(node[same], node[same + w])[ok])
                off.append(d[ok])
            keep = t.slice(max(0, len(t) - width)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, off)], ["a", "b", "off"])

    return rows.mapInArrow(run, "a long, b long, off int")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("items").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), "items"), "a")
    return left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("others")), "b").select("a", "b", "items", "others").mapInArrow(run, "a long, b long")


#: Rows of a block of a cell.
BLOCK = 512


def cells(placed: DataFrame) -> DataFrame:
    """(cell, i, j, node, root, s0..s3, main) for bands with several components: rows of a cell, dealt into
    pairs of blocks such that each row outside the main component meets every row."""
    counts = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    split = counts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("cell"), F.count("*").alias("roots")).where("roots > 1").select("band", "cell")
    rows = placed.join(split, "band").groupBy("cell", "node").agg(*(F.first(c).alias(c) for c in ("root", "s0", "s1", "s2", "s3")))
    rows = rows.withColumn("main", F.col("root") == F.col("cell"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count_if("main") / BLOCK).cast("int").alias("mains"), F.ceil(F.count_if(~F.col("main")) / BLOCK).cast("int").alias("others"))
    rows = rows.join(sizes, "cell")
    # blocks -mains..-1 are of the main component, 0..others-1 of the rest; pairs (i, j) have i <= j and j >= 0
    block = F.when(F.col("main"), -1 - F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("others", F.lit(1)))).cast("int")
    rows = rows.withColumn("block", block)
    partner = F.when(F.col("main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("others") - 1))
    rows = rows.withColumn("with", F.explode(partner))
    return rows.select("cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "root", "s0", "s1", "s2", "s3")


def across(dealt: DataFrame, sets: DataFrame, percent: int, slack: int) -> DataFrame:
    """Links (a, b) between different components of each pair of blocks, confirmed on full sets.

    Once a row is linked with a component its other rows are passed over: that can't change components.
    """

    def links(t: pa.Table, out: list):
        node, root, block = (t.column(c).to_numpy() for c in ("node", "root", "block"))
        planes = [t.column(c).to_numpy() for c in ("s0", "s1", "s2", "s3")]
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items").combine_chunks()]
        size = np.array([len(x) for x in items])
        label = {int(r): int(r) for r in np.unique(root)}

        def top(r):
            while label[r] != r:
                r = label[r]
            return r

        j = t.column("j")[0].as_py()
        for x in np.flatnonzero(block == j):
            off = np.zeros(len(node), np.int64)
            for p in planes:
                off |= p ^ p[x]
            off = np.bitwise_count(off.view(np.uint64))
            few, many = np.minimum(size, size[x]), np.maximum(size, size[x])
            ok = (off <= slack) & (root != root[x]) & ((block != j) | (node < node[x])) & (100 * few >= percent * many)
            for y in np.flatnonzero(ok)[np.argsort(off[ok], kind="stable")]:
                p, q = top(int(root[x])), top(int(root[y]))
                if p == q:
                    continue
                both = np.concatenate([items[x], items[y]])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * same >= percent * (len(both) - same):
                    label[p] = q
                    out.append((int(node[x]), int(node[y])))

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            key = [held.column(c).to_numpy() for c in ("cell", "i", "j")]
            cut = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            out, at = [], 0
            for c in cut.tolist():
                links(held.slice(at, c - at), out)
                at = c
            held = held.slice(at)
            yield made(out)
        if held is not None and len(held):
            links(held, out := [])
            yield made(out)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    parts = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.join(sets, "node").select("cell", "i", "j", "block", "node", "root", "s0", "s1", "s2", "s3", "items")
    return rows.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, items) of the wanted classes (node, k1, k2), from the whole text of the node's document."""

    def run(batches):
        for batch in batches:
            node, k1, items = [], batch.column("k1").to_pylist(), []
            for row, s in sets_of(batch.column("text"), k):
                key = int(s.sum(dtype=np.uint64))
                if (key - (1 << 64) if key >> 63 else key) == k1[row]:
                    node.append(batch.column("node")[row].as_py())
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return texts.join(wanted.select("node", "k1"), "node").select("node", "k1", "text").mapInArrow(run, "node long, items binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, best: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null or wordless texts have no shingles and link with nothing. A row without doc_id takes the id of
    its component's least doc_id; where there is none, component_id is null and the row is kept. Rows
    with equal texts, also repeated doc_ids, fall into one component; the least id is kept, by all rows
    that have it. Two texts under one id are told apart by their sets when links are confirmed, of which one
    stands for the id: without_copies numbers rows first and has no such case. Texts of any length count
    whole; other columns aren't read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    count, slack = layout(percent)
    marks = ws.save(signatures(docs, k, count))
    classes = marks.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("bands", "s0", "s1", "s2", "s3")))
    classes = ws.save(classes)
    banded = classes.select("node", F.explode("bands").alias("band"), "s0", "s1", "s2", "s3")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    banded = ws.save(banded.join(shared, "band").select("band", "node", "s0", "s1", "s2", "s3"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = banded.repartitionByRange(parts, "band", "s0", "s1", "node").sortWithinPartitions("band", "s0", "s1", "s2", "node")
    near = neighbours(ordered, slack, 2).groupBy("a", "b").agg(F.min("off").alias("off"))
    near = ws.save(near)
    rank = Window.partitionBy("b").orderBy("off", "a")
    star = Window.partitionBy("a").orderBy("off", "b")
    pick = near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= best).select("a", "b").union(near.withColumn("r", F.row_number().over(star)).where(F.col("r") <= best).select("a", "b")).distinct()
    pick = ws.save(pick)
    crowd = banded.select("node").distinct().join(classes.select("node", "k1"), "node")
    sets = ws.save(full_sets(docs, crowd, k))
    links = ws.save(confirm(pick, sets, percent))
    roots = components(links, ws)
    placed = ws.save(banded.join(roots, "node", "left").select("band", "node", "s0", "s1", "s2", "s3", F.coalesce("root", "node").alias("root")))
    more = ws.save(across(cells(placed), sets, percent, slack))
    roots = components(links.union(more), ws)
    named = classes.select("k1", "k2", "n_shingles", "node").join(roots, "node", "left").select("k1", "k2", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    out = marks.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    for t in (near, pick, banded, placed, sets):
        ws.drop(t)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """The rows of docs (doc_id, text, others) without near copies: exactly one row of each component stays,
    that of least doc_id, a null one last. Rows are told apart by a number of their own, so repeated rows and
    null or shared ids are rows like any other. Texts without shingles stay.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.save(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_hash", F.xxhash64(*docs.columns)))
    near = ws.save(near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), k, percent).where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")
    stay = near.join(rows.select("_row", "doc_id", "_hash"), "_row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    gone = near.select("_row").join(stay, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)
