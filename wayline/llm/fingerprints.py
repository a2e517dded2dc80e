"""Bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import SPACED, shingles, text_chunks, word_hashes

K = 128


def sketches(texts: pa.Array, k: int = K, words: int = 5) -> list[np.ndarray]:
    """The k least distinct shingle hashes of each text, ascending."""
    out = []
    for lo, hi, data, offsets in text_chunks(texts):
        _, _, hashes, first = word_hashes(data, offsets, SPACED)
        values, bounds = shingles(hashes, first, words)
        for d in range(hi - lo):
            part = values[bounds[d] : bounds[d + 1]]
            if len(part) > 4 * k:  # copies of one shingle may fill the least places: take more until k differ
                n = 2 * k
                while True:
                    part_n = np.unique(np.partition(part, n - 1)[:n]) if n < len(part) else np.unique(part)
                    if len(part_n) >= k or n >= len(part):
                        break
                    n *= 4
                part = part_n
            else:
                part = np.unique(part)
            out.append(part[:k])
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2**64)


def resemblance(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard: the share of both among the k least of the union. Two empty sketches are alike."""
    if not len(x) and not len(y):
        return 1.0
    both = np.concatenate([x, y])
    both.sort()
    fresh = np.concatenate([[True], both[1:] != both[:-1]])
    union = both[fresh]
    twice = both[1:][both[1:] == both[:-1]]
    top = union[min(k, len(union)) - 1]
    return float((twice <= top).sum()) / min(k, len(union))


def containment(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated share of x's shingles that y has."""
    r = resemblance(x, y, k)
    if not len(x):
        return 1.0
    return min(1.0, r / (1 + r) * (distinct(x, k) + distinct(y, k)) / distinct(x, k))


def fingerprints(df: DataFrame, key: str, text: str, k: int = K, words: int = 5) -> DataFrame:
    """key, sketch (ascending unsigned hashes kept as longs), distinct (estimate) of every row."""

    def run(batches):
        for batch in batches:
            found = sketches(batch.column(1), k, words)
            flat = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([distinct(s, k) for s in found], pa.float64())], [key, "sketch", "distinct"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, sketch array<long>, distinct double")


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """Sketch of the union of the sketched parts (key, sketch) of each key.

    Distinct hashes are combined before the shuffle and only k of a key and task go on, so a key may
    have any number of parts. Keys whose parts are all empty have no row.
    """
    flip = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    rows = parts.select(key, F.explode("sketch").alias("h")).select(key, flip.alias("h")).distinct()
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return least.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("h")), lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))).alias("sketch"))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, doc_id, text, own) in id order within buckets, each bucket followed by the row after it.

    Buckets are ranges of doc_id. The first row of the following bucket comes along with own = false; the
    last bucket is followed by the first row of all. Only ids are looked up for that, as many as buckets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    edges = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.0005)}) if parts > 1 else []
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    levels = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<bigint>")
    of = lambda c: F.aggregate(levels, F.lit(0), lambda n, e: n + F.when(c >= e, 1).otherwise(0))
    heads = sorted((r.bucket, r.head) for r in ids.groupBy(of(F.col("doc_id")).alias("bucket")).agg(F.min("doc_id").alias("head")).collect())
    after = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    own = docs.withColumn("bucket", of(order)).withColumn("own", F.lit(True))
    if not heads:
        return own.select("bucket", "doc_id", "text", "own")
    moved = F.element_at(F.create_map(*(F.lit(x) for kv in after.items() for x in kv)), order)
    guests = docs.where(order.isin(list(after))).withColumn("bucket", moved).withColumn("own", F.lit(False)).groupBy("bucket", "doc_id", "own").agg(F.min("text").alias("text"))
    rows = own.select("bucket", "doc_id", "text", "own").union(guests.select("bucket", "doc_id", "text", "own"))
    # by range: dealt by hash, several buckets would share a task while others have none
    return rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", F.desc("own"), order, "text")


def fingerprint_edits(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next,
    distinct_shingles, contained_in_edited of every row of docs (doc_id, text).

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as
    many (or all) of the next document by ascending doc_id; after the last comes the first. Null texts are
    empty, an empty text's fingerprint is empty, and two of these are alike. Null ids come first, equal
    ids go by text. A lone document is its own next one; an empty table gives no rows. Texts are sketched
    whole in chunks, so a very long one costs memory for itself alone; other columns aren't read.
    """
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def block(rows):
        """rows: (doc_id, text, sketch) of consecutive documents; all but the last are finished."""
        texts = [t for _, t, _ in rows]
        edited = []
        for a, b in zip(texts, texts[1:]):
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        out = sketches(pa.array(edited, pa.string()), k)
        data = {c: [] for c in ("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "contained_in_edited")}
        for i, new in enumerate(out):
            doc_id, text, own = rows[i]
            for c, v in zip(data, (doc_id, len(text), edited[i], encode(own), encode(new), resemblance(own, new, k), resemblance(own, rows[i + 1][2], k), distinct(own, k), containment(own, new, k)), strict=True):
                data[c].append(v)
        return pa.RecordBatch.from_pydict(data, pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), *((c, pa.float64()) for c in ("near_edited", "near_next", "distinct_shingles", "contained_in_edited"))]))

    def run(batches):
        held, bucket = None, None
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), sketches(part.column("text"), k), strict=True))
                places = part.column("bucket").to_pylist()
                start = 0
                for i in range(len(rows) + 1):
                    if i == len(rows) or (places[i] != bucket):
                        chain = ([held] if held is not None else []) + rows[start:i]
                        if len(chain) > 1:
                            yield block(chain)
                        if i < len(rows):  # the last row of a bucket is the guest
                            held, bucket, start = None, places[i], i
                        else:
                            held = chain[-1] if chain else None

    return with_next(docs, parts).mapInArrow(
        run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_edited double"
    )
