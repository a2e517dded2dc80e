import random
import re

import numpy as np
import pyarrow as pa

from wayline.llm import fingerprints as fp
from wayline.llm.words import SPACED, shingles, word_hashes


def edits(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[d] = (len(t), t[: len(t) - half] + n[:half])
    return out


def test_next_documents_over_buckets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for parts in (1, 7):
        got = {r.doc_id: (r.n_chars, r.edited) for r in fp.fingerprint_edits(docs, parts=parts).collect()}
        assert got == edits(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (5, "ünï " * 500), (9, "x" * 100_000), (12, "a b c d e f g")]
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, own int, bucket string")
    got = {r.doc_id: r for r in fp.fingerprint_edits(docs, parts=3).collect()}
    assert {d: (r.n_chars, r.edited) for d, r in got.items()} == edits(rows)
    assert got[1].fingerprint == "" and got[1].near_next == 1.0 and got[2].near_next == 0.0
    assert fp.fingerprint_edits(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "p q"), (4, "r"), (4, "r"), (4, "s")], "doc_id long, text string")
    assert fp.fingerprint_edits(twice, parts=2).count() == 4
    assert fp.fingerprint_edits(docs.where("doc_id = 12"), parts=2).first().near_next == 1.0


def test_estimates_and_merging(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    x, y = " ".join(words[:4000]), " ".join(words[2000:])
    a, b = fp.sketches(pa.array([x, y]))
    assert abs(fp.resemblance(a, b) - 1996 / 5996) < 0.15
    assert abs(fp.containment(a, b) - 0.5) < 0.2
    assert abs(fp.distinct(a) - 3996) < 1200
    assert (fp.decode(fp.encode(a)) == a).all()
    rows = [("k", " ".join(words[i : i + 504])) for i in range(0, 4000, 500)]
    parts = fp.fingerprints(spark.createDataFrame(rows, "g string, t string"), "g", "t")
    whole = fp.sketches(pa.array([" ".join(words[:4004])]))[0]
    assert (np.array(fp.merged(parts, "g").first().sketch, np.int64).view(np.uint64) == whole).all()


def least_hashes(text):
    """The bottom 128 of all distinct shingle hashes, by sorting them all."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, _, hashes, first = word_hashes(raw, np.array([0, len(raw)]), SPACED)
    return sorted(set(shingles(hashes, first, 5)[0].tolist()))[:128]


def test_query_equals_sorting_all_hashes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    plain = {d: least_hashes(t) for d, t in rows}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in rows}
    sizes = {d: len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) or bool(w) for d, w in words.items()}
    assert all(len(plain[d]) == min(128, sizes[d]) for d in plain)  # as many hashes as shingles

    def alike(x, y):
        union = sorted(set(x) | set(y))[:128]
        return len(set(union) & set(x) & set(y)) / len(union) if union else 1.0

    after = {d: rows[(i + 1) % len(rows)][0] for i, (d, _) in enumerate(rows)}
    for r in fp.fingerprint_edits(docs, parts=5).collect():
        edited = least_hashes(r.edited)
        assert fp.decode(r.fingerprint).tolist() == plain[r.doc_id] and fp.decode(r.edited_fingerprint).tolist() == edited
        assert r.near_edited == alike(plain[r.doc_id], edited) and r.near_next == alike(plain[r.doc_id], plain[after[r.doc_id]])
