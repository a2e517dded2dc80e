import os
import re
from itertools import permutations

import duckdb
import pytest

from wayline.llm.audit import AUDIT_SQL, audit_filters
from wayline.llm.queries import op13_filter_audit

DOCS = "doc_id long, text string, lang string, mask int, word string, n_chars long"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order applied to every row, one filter after another."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            bad.add("C")
        if re.search(r"[#$%&*|]", text):
            bad.add("D")
        if text in least and (i is None or i > least[text]):
            bad.add("E")
        rows.append((lang or "", bad, i in good, i in toxic))
    out, shapley = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                out[part, order, step] = [len(left) - len(removed), len(removed), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in left + gone), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                left, gone = [r for r in left if f not in r[1]], gone + removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], DOCS)
    out = audit_filters(df, spark.createDataFrame([(*r, "q") for r in labels], "doc_id long, quality int, toxic int, part string"))
    assert dict(out.dtypes)["step"] == "int" and all(dict(out.dtypes)[m] == "bigint" for m in MEASURES)
    rows = out.collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in MEASURES) for r in rows}


LONG = " ".join(f"w{i}" for i in range(250))
CASES = [
    (1, LONG, "en"),
    (2, LONG, "en"),  # a copy
    (3, LONG, "de"),  # a copy of the other language's
    (4, "short", "en"),
    (5, "A B C", "en"),
    (6, None, None),
    (7, "", "en"),  # the same text as a null one
    (8, "no " * 300, "en"),
    (9, LONG + " # ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ", "en"),
    (10, " \t\n\x0b\x0c\r", "fr"),
    (11, "café x   y" * 90, "fr"),
    (12, "AbC\x1cD|", "fr"),
    (None, LONG, "en"),
    (None, "only here", "en"),
    (None, "only here", "en"),
    (13, "twice the same row", "en"),
    (13, "twice the same row", "en"),
    (14, "one id", "en"),
    (14, "two texts", "en"),
    (15, ("x" * 70 + " ") * 3000, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (5, None, None), (8, 1, None), (None, 1, 1), (99, 1, 1)]


def test_equal_to_brute_force(spark):
    assert run(spark, CASES, LABELS) == brute(CASES, LABELS)


def test_large_group_of_copies(spark):
    docs = [(i, LONG if i % 3 else f"{LONG} {i}", "en" if i % 2 else "de") for i in range(300)]
    assert run(spark, docs, LABELS) == brute(docs, LABELS)


@pytest.mark.parametrize("labels", [[], LABELS])
def test_empty(spark, labels):
    assert run(spark, [], labels) == {}
    assert run(spark, CASES[:4], []) == brute(CASES[:4], [])


def test_sql_on_the_smallest_tables(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(AUDIT_SQL).fetchall()
    assert sorted(map(tuple, op13_filter_audit(spark, folder).select("part", "filter_order", "step", *MEASURES).collect())) == sorted(want)
