"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Pieces that one task packs together; a few of its last sequences may stay open.
POOL = 16384
#: Words that an encoder remembers (about 60 MB).
REMEMBERED = 400_000
END_ID = 1


class Words(dict):
    """Ids of words, as bytes of unsigned 32-bit little-endian integers, encoded when first asked for."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.encode(self.lead + word)
        return ids


class Encoder:
    """Ids of whole texts, equal to the tokenizer file's own.

    The byte-level tokenizer never joins a space with what stands before it, so texts whose blanks are
    single spaces and line ends are encoded word by word from memory; all others as a whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in letters]
        byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.plain = lambda text: array("I", core.encode_ordinary(text)).tobytes()
        self.first, self.spaced = Words(self.plain, ""), Words(self.plain, " ")
        self.line_end = self.plain("\n")

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if not text:
            return b""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
            return self.plain(text)
        out = []
        spaced = self.spaced.__getitem__
        for line in text.split("\n"):
            if line[0].isspace():
                return self.plain(text)
            head, *more = line.split(" ")
            if out:
                out.append(self.line_end)
            out.append(self.first[head])
            out += map(spaced, more)
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"


def pieces(docs: DataFrame, path: str, limit: int, most_loss: int) -> DataFrame:
    """Each text's ids and an end id, cut after `limit` ids or `most_loss` loss-bearing ones; ids are hashed,
    not kept. docs: doc_id, text, prompt (leading code points that bear no loss)."""

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(batch), 1024):
                out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss")}
                rest = (batch.column(i).slice(lo, 1024).to_pylist() for i in (1, 2))
                for doc_id, text, prompt in zip(ids[lo : lo + 1024], *rest, strict=True):
                    raw = encode(text or "") + END_ID.to_bytes(4, "little")
                    n, start = len(raw) // 4, 0
                    first = max(1, len(encode((text or "")[:prompt])) // 4) if prompt else 1  # the first id that bears loss
                    while start < n:
                        end = min(n, start + limit, max(start, first) + most_loss)
                        part = raw[4 * start : 4 * end]
                        for c, v in zip(out, (doc_id, start, end - start, zlib.crc32(part), n, end - max(start, min(end, first))), strict=True):
                            out[c].append(v)
                        start = end
                yield pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))

    return docs.mapInArrow(run, PIECES)


def pack_vectors(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A bin for each row of demands, so that no bin's sum exceeds limits in any dimension.

    Bins are filled one after another: of the kinds that still fit, the one whose demand has the largest
    dot product with what is left of the bin (both as shares of the limits) goes in next. Ties go to the
    first kind in descending order of demand. A row that exceeds the limits by itself is an error.
    """
    if not len(demands):
        return np.zeros(0, np.int64)
    if (demands > limits).any():
        raise ValueError("a piece exceeds the limits")
    kinds, of = np.unique(-demands, axis=0, return_inverse=True)
    kinds, of = -kinds, of.reshape(-1)
    order = np.argsort(of, kind="stable")
    at = np.searchsorted(of[order], np.arange(len(kinds)))
    left = np.bincount(of, minlength=len(kinds))
    shares = kinds / limits
    out = np.empty(len(demands), np.int64)
    live = np.arange(len(kinds))
    placed, bin_ = 0, -1
    while placed < len(demands):
        bin_ += 1
        room = limits.copy()
        live = live[left[live] > 0]
        fit = live
        while True:
            fit = fit[(kinds[fit] <= room).all(axis=1) & (left[fit] > 0)]
            if not len(fit):
                break
            k = fit[int(np.argmax(shares[fit] @ (room / limits)))]
            out[order[at[k]]] = bin_
            at[k] += 1
            left[k] -= 1
            room = room - kinds[k]
            placed += 1
    return out


def pack(table: DataFrame, limits: tuple[int, int, int], ws: Workspace) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, start, length, loss, ...).

    Rows are dealt by hash into pools of about POOL rows; a pool is packed by one task. Sequence ids are
    pool * 2**32 + a count.
    """
    pools = max(1, -(-table.count() // POOL))
    dealt = table.withColumn("pool", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(pools)))
    fields = [f for f in table.schema]

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        demands = np.stack([t["length"].to_numpy(), np.ones(len(t), np.int64), t["loss"].to_numpy()], axis=1)
        bins = pack_vectors(demands, np.array(limits))
        order = np.argsort(bins, kind="stable")
        size = demands[order, 0]
        before = np.cumsum(size) - size
        head = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        base = np.repeat(before[head], np.diff(np.append(np.flatnonzero(head), len(order))))
        offset = np.empty(len(t), np.int64)
        offset[order] = before - base
        t["sequence_id"] = (t["pool"].to_numpy() << 32) + bins
        t["offset"] = offset
        return t.drop(columns="pool")

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"])
    return dealt.groupBy("pool").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = 2048, segments: int = 64, loss_tokens: int = 2048, prompt: Column | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset: one row per piece.

    Every row of docs (doc_id, text) makes at least one piece: a null or empty text has the end id alone.
    prompt is the number of a text's leading code points that bear no loss, as instructions do; their ids
    are those of the prompt by itself. Without it loss-bearing are all ids but a document's first, which
    nothing precedes, and a loss limit of `tokens` never binds. Documents are cut after `tokens` ids or
    `loss_tokens` loss-bearing ones; full pieces fill a sequence, the last ones share. Rows with equal or
    null ids are packed like others, ties in demand by id and place; an empty table gives no rows. Very long
    texts are many pieces; other columns aren't read, unless prompt names them.
    """
    ws = Workspace(docs.sparkSession)
    mark = F.coalesce(prompt.cast("int"), F.lit(0)) if prompt is not None else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.alias("prompt"))
    table = ws.save(pieces(rows, path or default_tokenizer(), tokens, loss_tokens))
    return pack(table, (tokens, segments, loss_tokens), ws).withColumnRenamed("loss", "loss_tokens")
