"""Counts of each whole text, used by the quality rules and the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import GOLD, LOWER, M2, SPACED, mix, prefix_hash, runs, span_hash, text_chunks

_ALL = np.arange(256)
NOT_NEWLINE = _ALL != 0x0A
LEAD = (_ALL & 0xC0) != 0x80  # first bytes of code points
SYMBOLS = np.isin(_ALL, list(b"#*$%&|<>"))
UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
MARKS = np.isin(_ALL, list(b"!?;:_=+/\\@^~{}[]()"))
STOPS = np.isin(_ALL, list(b".,"))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_stops", "n_lines", "n_distinct", "n_stutter"]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    s = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        s *= M2
        s += words[j : j + len(s)]
    return s


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def counts_of(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of each text of a chunk; repeated windows and lines are told by 64-bit hashes."""
    n = len(offsets) - 1
    inside = SPACED[data]
    prefix = prefix_hash(data)
    starts, ends, first = runs(inside, offsets)
    words = span_hash(prefix, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first), "word_chars": per_text(inside & LEAD[data], offsets)}
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_marks", MARKS), ("n_stops", STOPS)):
        out[name] = per_text(table[data], offsets)

    a, b, first_line = runs(NOT_NEWLINE[data], offsets)
    seen = np.concatenate([[0], np.cumsum(inside)])
    full = seen[b] > seen[a]
    of = np.repeat(np.arange(n), np.diff(first_line))[full]
    key = mix(span_hash(prefix, a[full], b[full]) + of.astype(np.uint64) * GOLD)
    _, one = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[one], minlength=n)

    _, one = np.unique(mix(words + owner.astype(np.uint64) * GOLD), return_index=True)
    out["n_distinct"] = np.bincount(owner[one], minlength=n)

    out["n_stutter"] = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n)

    repeat = np.zeros(n, np.int64)
    if len(words) >= window:
        at = np.flatnonzero(owner[: len(words) - window + 1] == owner[window - 1 :])
        key = mix(windows(words, window)[at] + owner[at].astype(np.uint64) * GOLD)
        order = np.argsort(key)
        key = key[order]
        same = np.zeros(len(at), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:].copy()
        hit = at[order[same]]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        repeat = np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=n)
    out["n_repeat_words"] = repeat
    return out


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the COUNTS of every row of docs."""
    fields = docs.select(*keep).schema

    def run(batches):
        for batch in batches:
            parts = [counts_of(data, offsets) for _, _, data, offsets in text_chunks(batch.column(len(keep)))]
            arrays = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *arrays], [*keep, *COUNTS])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS)])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
