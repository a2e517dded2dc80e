import re

from wayline.llm.dedup import near_duplicates

DIR = "/root/testdata/sf0.001"


def brute(rows, percent=85):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert got(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_of_edits_and_odd_rows(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "One  TWO"), (105, "x " * 30000)]
    for n in range(40):  # a chain: neighbours are near, ends are not
        base = [*base[:n * 5], f"new{n}", *base[n * 5 + 1 :]]
        rows.append((n, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(docs)) == brute(rows)


def test_null_ids_repeated_rows_empty_table(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "alone in here")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, band int")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert out == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (None, None, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_large_group_of_varied_copies(spark, monkeypatch):
    import random

    from wayline.llm import dedup

    monkeypatch.setattr(dedup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for n in range(250):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(docs)) == brute(rows)
