"""Byte-pair encoding of whole texts by a lexicon of the corpus's frequent words; decoding.

The corpus's words are counted, the frequent ones encoded once on the driver and compiled into a minimal
acyclic transducer (lexicon.py), whose file every executor maps into memory. Tasks cut texts into words with
numpy and look all words of a chunk up at once; words that the lexicon hasn't are merged exactly, by rank.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import Lexicon, cut_for
from .packing import default_tokenizer
from .words import prefix_hash, span_hash, text_chunks
from .workspace import Workspace

#: Words in the lexicon at most, bytes of one at most; others are merged whenever they come (so results are the same).
WORDS, LONGEST = 65_536, 64
#: Words that a task counts, or remembers the ids of, before it lets go of them; ids decoded at once.
REMEMBERED, DECODED = 100_000, 1 << 17
#: Bytes of a word whose pairs are merged without a heap; a pair that isn't merged.
SHORT, NONE = 24, (1 << 40, 0)
LETTER, NUMBER, OTHER, SPACE = range(4)
CODE_POINTS = 0x110000


class Spec:
    """What a byte-level BPE file says: ids of bytes, merges, added tokens, bytes of ids."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain strings")
        # printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        byte, vocab = {c: b for b, c in letter.items()}, model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.byte_ids = [vocab[letter[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        known = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        raw = [known.get(i, b"") for i in range(max(known) + 1)]
        self.sizes = np.array([len(t) for t in raw])
        self.bytes, self.first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.find = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: of all neighbours the pair of lowest rank is joined, the leftmost first, until none is left."""
        ids, n, merges = [self.byte_ids[b] for b in word], len(word), self.merges
        if n <= SHORT:  # looking through all pairs is faster than keeping them in order
            pairs = [merges.get(p, NONE) for p in zip(ids, ids[1:])]
            while pairs and (best := min(pairs)) is not NONE:
                i = pairs.index(best)
                ids[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = merges.get((ids[i - 1], ids[i]), NONE)
                if i < len(pairs):
                    pairs[i] = merges.get((ids[i], ids[i + 1]), NONE)
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(merges[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue  # one of both is part of another by now
            ids[i], ids[j], after[i] = merges[pair][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in merges:
                    heappush(heap, (merges[p][0], a, p))
        return [i for i in ids if i >= 0]


@cache
def spec_of(path: str) -> Spec:
    return Spec(path)


@cache
def class_runs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """First code points of runs of one class, and the classes, as the tokenizer's own splitter has them (which
    knows a version of Unicode of its own)."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def one(c: str) -> int:
        return next((k for k, by in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(by + c + by)) == 1), SPACE)

    classes = np.full(CODE_POINTS, OTHER, np.uint8)
    apart = [c for c in map(chr, range(CODE_POINTS)) if c.isspace() or c == "'"]  # these join with others, or don't
    for c in apart:
        classes[ord(c)] = one(c)
    rest = [c for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000 and chr(c) not in apart]
    for lo in range(0, len(rest), 1 << 16):
        text = "".join(map(chr, rest[lo : lo + (1 << 16)]))
        for _, (a, z) in split(text):
            classes[rest[lo + a : lo + z]] = one(text[a])
    first = np.flatnonzero(np.diff(classes, prepend=255))
    return first.astype(np.int32), classes[first]


class Classes:
    """The class of every code point, from runs; tasks get the runs and make the table once."""

    made: dict[str, np.ndarray] = {}

    def __init__(self, path: str):
        self.path, self.runs = path, class_runs(path)

    def table(self) -> np.ndarray:
        if self.path not in self.made:
            first, classes = self.runs
            self.made[self.path] = np.repeat(classes, np.diff(first, append=CODE_POINTS))
        return self.made[self.path]


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the code point that each byte of UTF-8 belongs to."""
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        point = b & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            on = size > k
            point[on] = point[on] << 6 | (data[lead[on] + k] & 0x3F)
        out[lead] = table[point]
        for k in (1, 2, 3):
            on = size > k
            out[lead[on] + k] = out[lead[on]]
    return out


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, find: re.Pattern | None = None):
    """Starts and ends of the words of texts (UTF-8 from offsets[i] to offsets[i + 1]), each text's first word, and
    (start, string) of the added tokens among them.

    A word is a run of letters, of numbers or of other code points, with one space before it if there is one; a
    run of white space, less its last code point where a word follows; or an apostrophe with s, t, re, ve, m,
    ll or d.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    special = []
    if find is not None:
        raw = data.tobytes()
        special = [(m.start(), m.end(), m.group()) for m in find.finditer(raw)]
        special = [m for m in special if not cut[m[0] + 1 : m[1]].any()]  # within one text
        for a, z, _ in special:
            cut[a] = cut[z] = True
    kind = byte_classes(data, table)
    start = cut[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before a word of the same text: its last code point goes apart, or with the word
    word = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~cut[1:n]) + 1
    last = word - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    start[last] = True
    start[word[data[word - 1] == 0x20]] = False
    # contractions: an apostrophe that starts a word, before letters
    mark = np.flatnonzero((data == 0x27) & start)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~cut[mark + 1]]
    if len(mark):
        one = data[mark + 1]
        two = np.where(mark + 2 < n, data[np.minimum(mark + 2, n - 1)], 0)
        two[cut[mark + 2]] = 0
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((mark[short], 2), (mark[long], 3)):
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    for a, z, _ in special:
        start[a + 1 : z] = False
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets), [(a, t) for a, _, t in special]


def frequent_words(docs: DataFrame, path: str, ws: Workspace, most: int = WORDS, longest: int = LONGEST) -> list[bytes]:
    """Words of at most `longest` bytes that come most often in the texts of docs, `most` at most: those of the
    highest counts, in bins of a sixteenth of a power of two, as many bins as fit."""

    classes = Classes(path)

    def run(batches):
        counts: Counter = Counter()

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                starts, ends, _, _ = split_words(data, offsets, classes.table())
                short = ends - starts <= longest
                starts, ends, raw = starts[short], ends[short], data.tobytes()
                _, at, n = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_counts=True)
                for a, z, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                    counts[raw[a:z]] += k
                if len(counts) > REMEMBERED:
                    yield made()
                    counts.clear()
        yield made()

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    counts = ws.save(counts.groupBy("word").agg(F.sum("n").alias("n")).select("word", F.floor(16 * F.log2(F.col("n").cast("double"))).alias("bin")))
    bins = [(r.bin, r.n) for r in counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()]  # 1,024 at most
    cut = cut_for(bins, most)
    return [] if cut is None else counts.where(F.col("bin") >= cut).select("word").toArrow()["word"].to_pylist()


def send(data: bytes, ws: Workspace, name: str) -> None:
    """Writes a file into the shared folder and has every executor fetch it."""
    sc = ws.spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ws.root}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(data)
    out.close()
    sc.addFile(f"{ws.root}/{name}")


@cache
def mapped(name: str) -> Lexicon:
    return Lexicon.mapped(SparkFiles.get(name))


class Encoder:
    """Ids of chunks of texts, by the lexicon and, for all other words, by merging."""

    def __init__(self, spec: Spec, table: np.ndarray, lexicon: Lexicon):
        self.spec, self.table, self.lexicon = spec, table, lexicon
        self.seen: dict[bytes, list[int]] = {}

    def unseen(self, word: bytes) -> list[int]:
        ids = self.seen.get(word)
        if ids is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            ids = self.spec.merge(word)
            if len(word) <= 4 * LONGEST:
                self.seen[word] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin and the last ends."""
        starts, ends, first, special = split_words(data, offsets, self.table, self.spec.find)
        number, lexicon = self.lexicon.numbers(data, starts, ends), self.lexicon
        for a, t in special:
            number[np.searchsorted(starts, a)] = -1
        added = dict(special)
        known = len(lexicon.first) - 1
        new, at = [], np.flatnonzero(number < 0)
        raw = data.tobytes() if len(at) else b""
        for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
            new.append([self.spec.added[added[a]]] if a in added else self.unseen(raw[a:z]))
        # numbers past the lexicon's are this chunk's own
        number[at] = known + np.arange(len(at))
        sizes = np.concatenate([np.diff(lexicon.first), np.array([len(x) for x in new], np.int64)])
        ids = np.concatenate([lexicon.ids, np.array([i for x in new for i in x], np.int32)]).astype(np.int32)
        begin = np.cumsum(sizes) - sizes
        n = sizes[number]
        to = np.concatenate([[0], np.cumsum(n)])
        return ids[np.repeat(begin[number] - to[:-1], n) + np.arange(to[-1])], to[first]


def encode_texts(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, equal to the tokenizer file's own without special
    tokens being added; strings of added tokens in a text get their ids.

    docs: doc_id, text. The `words` most frequent words, counted over all texts, make the lexicon; with fewer, or
    none, only time differs. Null and empty texts have no ids; repeated rows and null doc_ids are rows like
    others; an empty table gives no rows. A text of any length is cut as a whole, a word of n bytes merged in
    n log n steps. Other columns aren't read, whatever their names.
    """
    path = path or default_tokenizer()
    spec, ws = spec_of(path), Workspace(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = frequent_words(rows, path, ws, words) if words > 0 else []
    name = f"lexicon-{ws.root.rsplit('-', 1)[-1]}"
    send(Lexicon.compile({w: spec.merge(w) for w in found if w}).to_bytes(), ws, name)

    classes = Classes(path)

    def run(batches):
        encoder = Encoder(spec_of(path), classes.table(), mapped(name))
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                ids, to = encoder.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str | None = None, name: str = "decoded") -> DataFrame:
    """rows with `name`, the text of their ids (array of int), in place of ids. Null lists and lists of none are
    empty texts; ids that the file hasn't, and null ones, say nothing; bytes that aren't UTF-8 become U+FFFD."""
    path = path or default_tokenizer()
    kept = [c for c in rows.columns if c != "ids"]
    if name in kept:
        raise ValueError(f"there is a column {name} already")

    def texts(lists: pa.Array) -> pa.Array:
        spec = spec_of(path)
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        ok = (ids >= 0) & (ids < len(spec.sizes))
        size = np.where(ok, spec.sizes[np.where(ok, ids, 0)], 0)
        to = np.concatenate([[0], np.cumsum(size)])
        raw = spec.bytes[np.repeat(spec.first[np.where(ok, ids, 0)] - to[:-1], size) + np.arange(to[-1])]
        ends = pa.array(to[np.concatenate([[0], np.cumsum(n)])], pa.int64())
        found = pa.Array.from_buffers(pa.large_binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(raw.tobytes())])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in found.to_pylist()], pa.string())

    def run(batches):
        for batch in batches:
            lists, lo = batch.column(len(kept)), 0
            to = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            while lo < len(batch):  # at most DECODED ids at once, or one longer list
                hi = max(lo + 1, int(np.searchsorted(to, to[lo] + DECODED, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), texts(part.column(len(kept)))], [*kept, name])
                lo = hi

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*(F.col(f"`{c}`") for c in kept), "ids").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{name}` string"]))
