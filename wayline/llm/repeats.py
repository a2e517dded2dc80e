"""Repeated byte strings across a corpus, by a suffix array sampled at content-chosen anchors.

A repeat of at least `size` bytes contains at least one anchor: among every run of 64-byte grams that
lies inside `size` bytes, those of least hash are chosen, so equal strings choose equal anchors.
1. One pass lists anchors with a hash of their context: all bytes that a `size`-byte string through the
   anchor can reach. Anchors that occur once are left out.
2. Contexts that occur twice or more are repeats as they stand; however many copies, they are counted,
   not compared.
3. The distinct contexts of an anchor are its occurrences in the sampled suffix array: Spark sorts them
   by (anchor, following bytes), neighbours give common-prefix lengths, a stack scan walks the tree of
   common-prefix intervals, and in each interval occurrences are ordered by the bytes before them, so
   that the left extensions tell which of them repeat over `size` bytes and how far.
Anchors with more distinct contexts than GROUP are split by window offset instead, one counted row each.
A second, shorter size (`least`) is read off the same anchors and intervals: anchors are then chosen within
`least` bytes, contexts still reach over `size`, and each interval is held against both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import GOLD, mix, prefix_hash, span_hash, text_chunks
from .workspace import Workspace

GRAM = 64
#: Most contexts of one anchor that one task compares (about 50 MB).
GROUP = 1 << 16
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of `width` values, by blocks."""
    n = len(x)
    pad = -n % width
    edge = TOP if best is np.minimum else np.uint64(0)
    blocks = np.concatenate([x, np.full(pad, edge)]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).reshape(-1)
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[: n - width + 1], ahead[width - 1 : n])


def anchors_in(data: np.ndarray, offsets: np.ndarray, size: int, least: int):
    """Positions, hashes, context hashes and rows of the anchors of a chunk of texts."""
    width = least - GRAM + 1
    n = len(data)
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if n < least or not (lengths >= least).any():
        return none, none.astype(np.uint64), none.astype(np.uint64), none
    prefix = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    grams = span_hash(prefix, at, at + GRAM)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    grams[(at + GRAM > offsets[owner + 1]) | (lengths[owner] < least)] = TOP
    least = sliding(grams, width, np.minimum)
    reach = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    pos = np.flatnonzero((grams == reach) & (grams != TOP))
    row = owner[pos]
    a, b = np.maximum(offsets[row], pos - (size - GRAM)), np.minimum(offsets[row + 1], pos + size)
    context = mix(span_hash(prefix, a, b) + (pos - a).astype(np.uint64) * GOLD)
    return pos - offsets[row], grams[pos], context, row


def meet(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, ws: Workspace) -> DataFrame:
    """rows joined with table on keys; n is a column of table: how many of the `total` rows have the key.

    Keys of more than a quarter of a task's fair share of rows, which are at most 4 to each partition, are
    looked up by broadcast where the rows lie; all others are shuffled. So no key fills a task.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fair = total // (4 * parts)
    hot = ws.save(table.where(F.col(n) > fair))
    rest = [c for c in table.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    cold = marked.where("_hot is null").select(*rows.columns).join(table.where(F.col(n) <= fair), keys)
    return marked.where("_hot").select(*rows.columns, *rest).unionByName(cold.select(*rows.columns, *rest))


def anchor_table(docs: DataFrame, size: int, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                pos, gram, context, row = anchors_in(data, offsets, size, least)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(pos.astype(np.int64)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))],
                    ["id", "key", "pos", "anchor", "context"],
                )

    return docs.mapInArrow(run, "id long, key long, pos long, anchor long, context long")


def keyed(docs: DataFrame, *rest: str) -> DataFrame:
    """(doc_id, id, key, text): rows are told apart by their id and text, also where ids are null or repeat."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1)).alias("id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"), *rest)


def contexts_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The bytes before (nearest first) and after each wanted anchor occurrence."""

    def run(batches):
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            out = {c: [] for c in ("anchor", "context", "single", "id", "key", "pos", "before", "after")}
            for i, found in enumerate(batch.column("found").to_pylist()):
                text = raw[i].as_py()
                for x in found:
                    p = x["pos"]
                    out["before"].append(text[max(0, p - size + GRAM) : p][::-1])
                    out["after"].append(text[p : p + size])
                    for c in ("anchor", "context", "single", "pos"):
                        out[c].append(x[c])
                out["id"] += [batch.column("id")[i].as_py()] * len(found)
                out["key"] += [batch.column("key")[i].as_py()] * len(found)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("single", pa.bool_()), ("id", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()), ("before", pa.binary()), ("after", pa.binary())]))

    grouped = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "context", "pos", "single")).alias("found"))
    return docs.join(grouped, ["id", "key"]).mapInArrow(run, "anchor long, context long, single boolean, id long, key long, pos long, before binary, after binary")


def matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of bytes, and their lengths."""
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int32, n + 1, values.offset * 4).astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros((n, width), np.uint8)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = data[offsets[0] : offsets[-1]]
    return out, lengths


def common(x: np.ndarray, xl: np.ndarray, y: np.ndarray, yl: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows."""
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(first, np.minimum(xl, yl))


def intervals(lcp: list[int], q: int):
    """(length, first, last) of the common-prefix intervals of q sorted suffixes; lcp[i] is of i-1 and i."""
    stack = [[0, 0]]
    for i in range(1, q + 1):
        now = lcp[i] if i < q else -1
        start = i - 1
        while stack and stack[-1][0] > now:
            length, start = stack.pop()
            if length and i - 1 > start:
                yield length, start, i - 1
        if i < q and (not stack or stack[-1][0] < now):
            stack.append([now, start])


def extend_group(after, after_len, before, before_len, sizes: list[int], nodes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right each occurrence of an anchor repeats; both 0 where it doesn't reach the size.

    One row for each of `sizes`, which fall; nodes are of the last.

    Rows come in suffix order. Maximal repeats, (back, ahead, members), are added to nodes: members of an
    interval that share `back` bytes on the left, not all of them more, and don't all lie in a deeper one.
    """
    q, size = len(after), sizes[-1]
    left, right = np.zeros((len(sizes), q), np.int64), np.zeros((len(sizes), q), np.int64)
    lcp = np.zeros(q, np.int64)
    lcp[1:] = common(after[1:], after_len[1:], after[:-1], after_len[:-1])
    keys = [before[i, : before_len[i]].tobytes() for i in range(q)]
    order = np.array(sorted(range(q), key=keys.__getitem__))
    rank = np.empty(q, np.int64)
    rank[order] = np.arange(q)
    backs = np.zeros(q, np.int64)
    backs[1:] = common(before[order[1:]], before_len[order[1:]], before[order[:-1]], before_len[order[:-1]])
    levels = [backs]  # levels[j][i]: the least of backs[i : i + 2**j]
    while 2 << (len(levels) - 1) <= q:
        w = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
    most = int(backs.max())
    for length, lo, hi in intervals(lcp.tolist(), q):
        if length + most < size:
            continue
        ranks = np.sort(rank[lo : hi + 1])
        a, b = ranks[:-1] + 1, ranks[1:] + 1
        step = np.log2(b - a).astype(np.int64)
        back = np.empty(len(a), np.int64)
        for j in np.unique(step):
            m = step == j
            back[m] = np.minimum(levels[j][a[m]], levels[j][b[m] - (1 << int(j))])
        reach = np.zeros(len(ranks), np.int64)
        reach[:-1] = back
        reach[1:] = np.maximum(reach[1:], back)
        if nodes is not None:
            for run in np.split(np.arange(len(ranks)), np.flatnonzero(back + length < size) + 1):
                members = np.sort(order[ranks[run]])
                if len(run) > 1 and (lcp[members[0] + 1 : members[-1] + 1] == length).any():
                    nodes.append((int(back[run[:-1]].min()), length, members))
        for k, s in enumerate(sizes):
            ok = reach + length >= s  # at least two of them share these bytes on both sides
            hit = order[ranks[ok]]
            left[k, hit] = np.maximum(left[k, hit], reach[ok])
            right[k, hit] = np.maximum(right[k, hit], length)
    return left, right


#: level: 0 where `size` bytes repeat, 1 where only `least` do.
SPANS = "id long, key long, start long, end long, level int"
NODES = "anchor long, context long, group long, back long, ahead long"


def extend(contexts: DataFrame, sizes: list[int], nodes: bool = False) -> DataFrame:
    """Spans (SPANS) of the single contexts that repeat in part; with nodes, the maximal repeats of all
    contexts instead (NODES), one row for each context that is a member."""
    size = sizes[0]

    def scan(t: pa.Table):
        t = t.combine_chunks()
        flat = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        anchor = t.column("anchor").to_numpy()
        after, after_len = matrix(flat("after"), size)
        before, before_len = matrix(flat("before"), size - GRAM)
        bounds = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        left, right = np.zeros((len(sizes), len(anchor)), np.int64), np.zeros((len(sizes), len(anchor)), np.int64)
        two = bounds[:-1][np.diff(bounds) == 2]
        r = common(after[two], after_len[two], after[two + 1], after_len[two + 1])
        b = common(before[two], before_len[two], before[two + 1], before_len[two + 1])
        for k, least in enumerate(sizes):
            ok = r + b >= least
            for i in (two[ok], two[ok] + 1):
                left[k, i], right[k, i] = b[ok], r[ok]
        made = [(x, y, np.array([i, i + 1])) for i, x, y in zip(two[ok].tolist(), b[ok].tolist(), r[ok].tolist(), strict=True)] if nodes else None
        for g in np.flatnonzero(np.diff(bounds) > 2):
            s = slice(bounds[g], bounds[g + 1])
            found = [] if nodes else None
            left[:, s], right[:, s] = extend_group(after[s], after_len[s], before[s], before_len[s], sizes, found)
            if nodes:
                made += [(x, y, members + bounds[g]) for x, y, members in found]
        if nodes:
            counts = np.array([len(m) for *_, m in made], np.int64)
            rows = np.concatenate([m for *_, m in made]) if made else np.zeros(0, np.int64)
            back, ahead = (np.array([x[i] for x in made], np.int64) for i in (0, 1))
            context = t.column("context").to_numpy()
            head = np.array([context[m].min() for *_, m in made], np.int64)
            key = mix(head.view(np.uint64) * GOLD + (back * 65536 + ahead).view(np.uint64)) if made else np.zeros(0, np.uint64)
            spread = lambda x: pa.array(np.repeat(x, counts))
            return pa.RecordBatch.from_arrays([pa.array(anchor[rows]), pa.array(context[rows]), spread(key.view(np.int64)), spread(back), spread(ahead)], ["anchor", "context", "group", "back", "ahead"])
        hit = (left + right > 0) & t.column("single").to_numpy(zero_copy_only=False)
        hit[1:] &= (left[1:] != left[:-1]) | (right[1:] != right[:-1])  # else said already
        level, out = np.nonzero(hit)
        pos = t.column("pos").to_numpy()[out]
        take = pa.array(out)
        return pa.RecordBatch.from_arrays([flat("id").take(take), flat("key").take(take), pa.array(pos - left[hit]), pa.array(pos + right[hit]), pa.array(level.astype(np.int32))], ["id", "key", "start", "end", "level"])

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            anchor = held.column("anchor").to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1]))  # its group may go on
            done = 0
            while last - done >= 8192:
                stop = int(np.searchsorted(anchor, anchor[done + 4096], "right"))
                yield scan(held.slice(done, stop - done))
                done = stop
            held = held.slice(done)
        anchor = held.column("anchor").to_numpy() if held is not None else []
        done = 0
        while done < len(anchor):
            stop = int(np.searchsorted(anchor, anchor[min(done + 4096, len(anchor) - 1)], "right"))
            yield scan(held.slice(done, stop - done))
            done = stop

    parts = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return contexts.repartition(parts, "anchor").sortWithinPartitions("anchor", "after").mapInArrow(run, NODES if nodes else SPANS)


def extend_wide(contexts: DataFrame, sizes: list[int], nodes: bool = False) -> DataFrame:
    """The same for anchors of any number of contexts: windows are counted by offset, with combining; as
    nodes, each window that repeats is one."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                before, after = batch.column("before")[i].as_py(), batch.column("after")[i].as_py()
                raw = np.frombuffer(before[::-1] + after, np.uint8)
                for level, size in enumerate(sizes):
                    starts = np.arange(max(0, len(before) - size + GRAM), min(len(before), len(raw) - size) + 1)  # through the anchor
                    n = len(starts)
                    if not n:
                        continue
                    h = span_hash(prefix_hash(raw), starts, starts + size)
                    rep = lambda c: pa.array([batch.column(c)[i].as_py()] * n)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([rep("anchor"), rep("context"), pa.array(h.view(np.int64)), pa.array(batch.column("pos")[i].as_py() - len(before) + starts), pa.array(len(before) - starts), pa.array(np.full(n, size)), pa.array(np.full(n, level, np.int32)), rep("id"), rep("key"), rep("single")], ["anchor", "context", "window", "start", "back", "size", "level", "id", "key", "single"])

    rows = contexts.mapInArrow(run, "anchor long, context long, window long, start long, back long, size long, level int, id long, key long, single boolean")
    place = F.struct("id", "key", "start")  # a window through two equal grams comes twice
    again = rows.groupBy("anchor", "window").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").drop("lo", "hi")
    if nodes:
        hit = rows.join(again, ["anchor", "window"])
        return hit.select("anchor", "context", F.xxhash64("anchor", "window").alias("group"), "back", (F.col("size") - F.col("back")).alias("ahead"))
    hit = rows.where("single").join(again, ["anchor", "window"])
    one = hit.groupBy("id", "key", "anchor", "context", "level")  # a text may have the anchor at several places
    return one.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end")).select("id", "key", "start", "end", "level")


def occurrences(texts: DataFrame, size: int, least: int, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors that occur twice or more (id, key, pos, anchor, context); their distinct contexts with counts
    and one occurrence; and of those the ones that must be compared, as some context of the anchor is single."""
    anchors = ws.save(anchor_table(texts.select("id", "key", "text"), size, least))
    again = anchors.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1")
    found = ws.save(meet(anchors, again, ["anchor"], "times", anchors.count(), ws).select(*anchors.columns))
    ws.drop(anchors)
    kinds = ws.save(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "pos")).alias("one")))
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select("anchor", "contexts")
    met = meet(kinds, groups, ["anchor"], "contexts", kinds.count(), ws)
    wanted = ws.save(met.select("anchor", "contexts", "context", (F.col("n") == 1).alias("single"), "one.id", "one.key", "one.pos"))
    return found, kinds, wanted


def repeated_spans(docs: DataFrame, sizes: list[int], ws: Workspace) -> DataFrame:
    """(id, key, spans): bytes of each text that lie in a string of `size` bytes found twice or more, as (start,
    end, level); level 1 has what lies only in strings of the second of `sizes`. A text of fewer than `size`
    bytes that repeats as a whole has level 0 all the same."""
    texts, size = keyed(docs), sizes[0]
    found, kinds, wanted = occurrences(texts, size, sizes[-1], ws)
    whole = meet(found, kinds.where("n > 1").select("anchor", "context", "n"), ["anchor", "context"], "n", found.count(), ws)
    copies = whole.select("id", "key", F.greatest(F.lit(0), F.col("pos") - (size - GRAM)).alias("start"), (F.col("pos") + size).alias("end"), F.lit(0).alias("level"))
    narrow, wide = wanted.where(F.col("contexts") <= GROUP), wanted.where(F.col("contexts") > GROUP)
    spans = copies.union(extend(contexts_of(texts, narrow, size), sizes))
    if not wide.isEmpty():
        spans = spans.union(extend_wide(contexts_of(texts, wide, size), sizes))
    per_text = ws.save(spans.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end", "level")).alias("spans")))
    for t in (found, kinds, wanted):
        ws.drop(t)
    return per_text


def repeat_groups(docs: DataFrame, size: int = 400) -> DataFrame:
    """group, length, doc_id, start: every occurrence of each maximal repeat of `size` bytes or more, one row each.

    A group is a node of an anchor's common-prefix interval tree whose members differ in what comes before
    and after the bytes they share, or a context that repeats as a whole. length counts the bytes from
    `start` that its occurrences share around the anchor, at most size - GRAM before and size after it: a
    longer repeat, having several anchors, comes as several groups. Anchors of more than GROUP distinct
    contexts give a group for each repeated window of `size` bytes. Members are rows, never lists, so a
    group may have any number of them. Null texts are empty, null ids stay null; repeated rows are
    occurrences of their own.
    """
    ws = Workspace(docs.sparkSession)
    texts = keyed(docs)
    found, kinds, wanted = occurrences(texts, size, size, ws)
    total, keys = found.count(), ["anchor", "context"]
    lengths = texts.select("id", "key", F.octet_length("text").alias("bytes")).dropDuplicates(["id", "key"])
    whole = meet(found, kinds.where("n > 1").select(*keys, "n"), keys, "n", total, ws).join(lengths, ["id", "key"])
    back = F.least(F.col("pos"), F.lit(size - GRAM))
    whole = whole.select(F.xxhash64(*keys).alias("group"), (back + F.least(F.col("bytes") - F.col("pos"), F.lit(size))).alias("length"), "id", (F.col("pos") - back).alias("start"))
    narrow, wide = wanted.where(F.col("contexts") <= GROUP), wanted.where(F.col("contexts") > GROUP)
    nodes = extend(contexts_of(texts, narrow, size), [size], nodes=True)
    if not wide.isEmpty():
        nodes = nodes.union(extend_wide(contexts_of(texts, wide, size), [size], nodes=True))
    nodes = ws.save(nodes.distinct().join(kinds.select(*keys, "n"), keys))
    partly = meet(found, nodes, keys, "n", total, ws).select("group", (F.col("back") + F.col("ahead")).alias("length"), "id", (F.col("pos") - F.col("back")).alias("start"))
    return whole.where(F.col("length") >= size).union(partly).select("group", F.col("length").cast("long").alias("length"), F.when(F.col("id") != -1, F.col("id")).alias("doc_id"), F.col("start").cast("long").alias("start"))


def merge_spans(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, length)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, size: int = 400, carry: bool = False, least: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs (doc_id, text); with carry,
    docs' own columns, the text being what is kept (a code point that is cut into is left out).

    Null texts are empty; texts shorter than `size` bytes stay whole. Rows that repeat a text lose all
    of it (from `size` bytes on), the first one included. Without carry, other columns aren't read.

    With least (GRAM to size; not with carry), n_repeated and n_runs follow: bytes that lie in a string of `least`
    bytes found twice or more, and their maximal runs. They are counted, not removed.
    """
    if least is not None and (carry or not GRAM <= least <= size):
        raise ValueError(f"least goes without carry and lies between {GRAM} and size")
    ws = Workspace(docs.sparkSession)
    spans = repeated_spans(docs, [size] if least is None else [size, least], ws)
    rest = [c for c in docs.columns if c != "text"] if carry else []
    own = {c: f"_own_{i}" for i, c in enumerate(rest)}
    base = docs.select("doc_id", "text", *(F.col(c).alias(v) for c, v in own.items()))

    def run(batches):
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            lengths, removed, runs, kept, repeated, all_runs = [], [], [], [], [], []
            for text, found in zip(raw, batch.column("spans").to_pylist(), strict=True):
                found = found or []
                merged = merge_spans([(x["start"], x["end"]) for x in found if not x["level"]], len(text)) if len(text) >= size else []
                if least is not None:
                    both = merge_spans([(x["start"], x["end"]) for x in found], len(text))
                    repeated.append(sum(b - a for a, b in both))
                    all_runs.append(len(both))
                lengths.append(len(text))
                removed.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
                ends = [0, *(b for _, b in merged)]
                kept.append(b"".join(text[x:y] for x, y in zip(ends, [*(a for a, _ in merged), len(text)], strict=True)) if merged else text)
            if carry:
                texts = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(v) for v in own.values()), texts], [*own.values(), "text"])
                continue
            longs = [pa.array(x, pa.int64()) for x in (lengths, removed, runs)]
            more = {} if least is None else {"n_repeated": pa.array(repeated, pa.int64()), "n_runs": pa.array(all_runs, pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(kept, pa.binary()), *more.values()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *more])

    joined = keyed(base, *own.values()).join(spans, ["id", "key"], "left")
    if carry:
        kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
        out = joined.select("text", "spans", *own.values()).mapInArrow(run, ", ".join([*(f"{v} {kinds[c]}" for c, v in own.items()), "text string"]))
        return out.select(*(F.col(own[c]).alias(c) if c != "text" else F.col("text") for c in docs.columns))
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + (", n_repeated long, n_runs long" if least is not None else ""))
