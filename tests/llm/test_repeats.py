import random
from collections import Counter

import pytest

from wayline.llm import repeats
from wayline.llm.repeats import extend_group, intervals, remove_repeats

DIR = "/root/testdata/sf0.001"


def brute(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[j : j + size] for _, t in raw for j in range(len(t) - size + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for j in range(len(t) - size + 1):
            if count[t[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        runs = sum(1 for j, x in enumerate(gone) if x and not (j and gone[j - 1]))
        out.append((i, len(t), sum(gone), runs, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("n_chars < 5000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(remove_repeats(docs)) == brute(rows, 400)


def cases():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a, b = text(450), text(300)
    rows = [(1, text(200) + a + text(100)), (2, a), (3, text(90) + a[20:] + b), (4, a[:420] + text(50) + b), (5, "x" * 2000), (6, "xy" * 700), (7, None), (8, ""), (9, "short")]
    rows += [(None, a + b), (10, a + b), (10, a + b), (10, text(500)), (11, text(37) + "x" * 399), (12, (text(30) * 40))]
    return rows + [(100 + n, text(50 + n) + a[n % 40 :] + text(60)) for n in range(30)]


@pytest.mark.parametrize("group", [1 << 16, 3])
def test_overlaps_runs_and_odd_rows(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 3: large groups go by window offsets
    rows = cases()
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, key string, pos int")
    assert got(remove_repeats(docs)) == brute(rows, 400)
    assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1 << 16, 3])
@pytest.mark.parametrize("least", [100, 250, 400])
def test_second_size_equals_brute_force(spark, monkeypatch, group, least):
    """The columns of the second size are those of a run at that size; those of the first stay."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(least)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    c = text(180)
    rows = cases() + [(300, c), (301, c), (302, c[:150] + text(400)), (303, text(99) + c[30:] + text(300) + c[:170])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeats(docs, size=400, least=least)
    assert got(out) == brute(rows, 400)
    runs = sorted(((r.doc_id, r.n_bytes, r.n_repeated, r.n_runs) for r in out.collect()), key=str)
    assert runs == sorted((x[:4] for x in brute(rows, least)), key=str)
    assert remove_repeats(docs.limit(0), size=400, least=least).count() == 0


def test_anchor_twice_in_a_text(spark, monkeypatch):
    """Bytes between two places of an anchor stay, however many contexts it has."""
    monkeypatch.setattr(repeats, "GROUP", 3)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a = text(170)
    rows = [(n, text(200) + a[n:] + text(900) + a[: 170 - n] + text(200)) for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(docs, size=150)) == brute(rows, 150)


def test_query_tells_passages_of_51_words(spark, tmp_path):
    """op7: shared passages of 51 words, 305 and 356 bytes, show in passage_bytes; no other text does."""
    from wayline.llm.queries import QUERIES

    rng = random.Random(11)
    words = lambda n, k: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(k + i % 3)) for i in range(n))
    rows = [(n, words(150, 5)) for n in range(40)]
    planted = {}
    for n in range(0, 40, 4):
        passage = words(51, 4 + n // 4 % 2)
        assert len(passage) in (305, 356)
        for d in (n, n + 1):
            rows[d] = (d, rows[d][1] + "\n" + passage + "\n" + words(20, 6))
            planted[d] = len(passage) + 2  # and its line ends
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op7_suffix_array_dedup"](spark, str(tmp_path)).collect():
        assert r.n_removed == r.n_spans == 0 and r.text == rows[r.doc_id][1]
        assert planted.get(r.doc_id, 0) <= r.passage_bytes <= planted.get(r.doc_id, 0) + 2 * (r.doc_id in planted)
        assert r.passage_spans == (r.doc_id in planted)


def test_interval_tree():
    words = sorted(["banana", "bandana", "band", "ban", "can", "candy"])
    lcp = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])]
    assert set(intervals(lcp, len(words))) == {(3, 0, 3), (4, 2, 3), (3, 4, 5)} or set(intervals(lcp, len(words))) >= {(3, 0, 3), (3, 4, 5)}


def maximal(rows, size):
    """{string: places} of all maximal repeats of at least `size` bytes, by brute force."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    todo, seen = {}, {}
    for d, (_, t) in enumerate(raw):
        for j in range(len(t) - size + 1):
            todo.setdefault(t[j : j + size], []).append((d, j))
    for places in (p for p in todo.values() if len(p) > 1):
        level = {0: places}
        n = size
        while level:  # grow to the right while members agree
            nxt = []
            for group in level.values():
                by = {}
                for d, j in group:
                    by.setdefault(raw[d][1][j + n : j + n + 1] or (d, j), []).append((d, j))
                if len(by) > 1:
                    lefts = {raw[d][1][j - 1 : j] if j else (d, j) for d, j in group}
                    if len(lefts) > 1:
                        seen[raw[group[0][0]][1][group[0][1] : group[0][1] + n]] = sorted(((raw[d][0], j) for d, j in group), key=str)
                nxt += [g for k, g in by.items() if isinstance(k, bytes) and len(g) > 1]
            level, n = dict(enumerate(nxt)), n + 1
    return seen


@pytest.mark.parametrize("group", [1 << 16, 2])
def test_maximal_repeat_groups(spark, monkeypatch, group):
    """Each maximal repeat comes with all its places, cut to the reach of an anchor's context."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(120), text(110)
    rows = [(1, text(70) + a + text(40)), (2, text(90) + a + text(60)), (3, text(30) + a[10:] + text(80)), (4, b + text(75)), (5, text(64) + b), (6, text(50) + a[:105] + text(20) + b + text(9)), (7, None), (None, text(66) + b + text(31))]
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, pos long, context string")
    out = repeats.repeat_groups(docs, 100)
    groups = {}
    raw = {d: (t or "").encode() for d, t in rows}
    for r in out.collect():
        groups.setdefault((r.group, r.length), set()).add((r.doc_id, r.start))
    strings = {}
    for (_, length), places in groups.items():
        found = {raw[d][s : s + length] for d, s in places}
        assert len(found) == 1 and len(places) > 1 and length >= 100  # all occurrences of a group are equal
        strings.setdefault(found.pop(), set()).update(places)
    want = maximal(rows, 100)

    def members(places):  # which texts and how far apart, wherever an anchor's context cuts the string
        first = min(places, key=str)
        return frozenset((d, j - first[1]) for d, j in places)

    if group > 2:
        assert {members(v) for v in strings.values()} == {members(v) for v in want.values()}
    for k, places in strings.items():  # none is left out
        assert places == {(d, j) for d, t in raw.items() for j in range(len(t)) if t[j : j + len(k)] == k}
    assert repeats.repeat_groups(docs.limit(0), 100).count() == 0
