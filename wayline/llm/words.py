"""Vectorised words, hashes and shingles of Arrow text columns.

Texts are handled as UTF-8 in chunks of about half a megabyte (one longer text makes a chunk of its
own), so memory in a task is bounded by the chunk or by the longest text. All word separators used
here are ASCII, so cutting bytes at them equals cutting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ALL = np.arange(256)
#: bytes that belong to words: [^\x20\x09-\x0D]+
SPACED = ~np.isin(_ALL, [0x20, *range(0x09, 0x0E)])
#: bytes that belong to words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


TABLE = mix((np.arange(1, 257, dtype=np.uint64)) * GOLD)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        made = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n, lo + 4096)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of kept bytes that don't cross texts; and each text's first run."""
    n = len(keep)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = keep[:-1]
    starts = np.flatnonzero(keep & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = keep[1:]
    ends = np.flatnonzero(keep & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes starts..ends, equal wherever the bytes are equal."""
    h = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    h += (ends - starts).astype(np.uint64) * GOLD
    return mix(h)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED):
    """Starts, ends and hashes of words; and each text's first word."""
    starts, ends, first = runs(table[data], offsets)
    return starts, ends, span_hash(prefix_hash(data), starts, ends), first


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in text order, and each text's first shingle.

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(bounds[-1], np.uint64)
    n = len(words)
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s *= M2
            s += words[j : n - k + 1 + j]
        long = counts >= k
        take = np.repeat(first[:-1][long] - bounds[:-1][long], sizes[long])
        where = np.flatnonzero(np.repeat(long, sizes))
        out[where] = s[where + take]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = int(counts[d])
        for w in words[first[d] : first[d + 1]].tolist():
            h = (h * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
        out[bounds[d]] = h
    return mix(out), bounds
