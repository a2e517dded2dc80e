import math
import re
import zlib
from collections import Counter

import numpy as np

from wayline.llm.ranking import FEATURES, OFFSET, PAIRS, PRIOR, RATES, bradley_terry, pairs_of, score_quality
from wayline.llm.toxicity import Index, held_out, platt, score_toxicity

DIR = "/root/testdata/sf0.1"


def accuracy(rows, label):
    rows = [r for r in rows if r.held_out]
    assert len(rows) > 500
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    assert accuracy(rows, "toxic") > 0.95 and all(0 <= r.score <= 1 for r in rows)
    flipped = labels.withColumn("toxic", (labels.toxic + held_out(labels.doc_id, 5, 0).cast("int")) % 2)
    again = {r.doc_id: r.score for r in score_toxicity(docs, flipped).where("doc_id < 300").collect()}
    assert again == {r.doc_id: r.score for r in out.where("doc_id < 300").collect()}  # held-out labels play no part


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    assert accuracy(rows, "quality") > 0.97


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 5, 40)
    bare = Index(idf, [], np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
    made = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        made.append((t, bare.unit(t, rng.integers(1, 9, len(t)))))
    index = Index(idf, made, np.ones(700), np.ones(700), np.arange(700))
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(made):
        dense[i, t] = w
    for t, w in made[:80]:
        docs, cosines = index.nearest(t, w, 10)
        all_ = dense[:, t] @ w
        want = np.lexsort((np.arange(700), -np.round(all_, 12)))[:10]
        assert docs.tolist() == want[all_[want] > 0].tolist() and np.allclose(cosines, all_[docs])


def test_bradley_terry_ranks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    s = x @ np.array([2.0, -1.0, 0.0])
    a, b = x[:200], x[200:]
    first = (s[:200] > s[200:])[:, None]
    w = bradley_terry(np.where(first, a, b), np.where(first, b, a))
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * abs(w[1])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "fine words here"), (4, "idiot " * 30000), (4, "idiot " * 30000)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 1), (4, 1, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (score_toxicity, score_quality):
        got = f(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert f(docs.limit(0), labels).count() == 0
        assert all(0 <= r.score <= 1 for r in f(docs, labels.limit(0)).collect())


def test_toxicity_weighs_rare_words(spark):
    """Toxic texts whose telling words are each in few of them (far below any chi-square bound), no word left out."""
    import random

    rng = random.Random(3)
    plain, bad = [f"p{i}" for i in range(300)], [f"bad{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(600):
        words = rng.sample(plain, 12) + (rng.sample(bad, 3) if i % 3 == 0 else []) + [f"only{i}"]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = [r for r in score_toxicity(docs, labels).collect() if r.held_out]
    caught = [r.predicted for r in got if r.doc_id % 3 == 0]
    assert len(caught) > 20 and sum(caught) / len(caught) > 0.8
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) / len(got) > 0.9
    assert all(r.evidence and 0 < r.evidence[0].cosine < 0.999 for r in got)


def brute_toxicity(rows, marks):
    """Scores by dense vectors over all words of the examples, every example met: {doc_id: (score, nearest)}."""
    words = {d: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for d, t in rows}
    learn = {d: y for d, y in marks.items() if zlib.crc32(str(d).encode()) % 5}
    n = [sum(y == k for y in learn.values()) for k in (0, 1)]
    having = [Counter(w for d, y in learn.items() if y == k for w in words[d]) for k in (0, 1)]
    df = Counter(w for d in words for w in words[d])
    weight = {}
    for w in having[0] | having[1]:
        a, b = having[1][w], having[0][w]
        odds = math.log((a + 0.5) / (n[1] - a + 0.5)) - math.log((b + 0.5) / (n[0] - b + 0.5))
        sure = max(0.0, abs(odds) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
        weight[w] = (math.log((1 + len(rows)) / (1 + df[w])) + 1) * (0.1 + sure)
    vector = lambda d: {w: (1 + math.log(c)) * weight[w] for w, c in words[d].items() if w in weight}
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    kinds = {}
    for d in sorted(learn):
        if words[d]:
            kinds.setdefault(frozenset(words[d].items()), []).append(d)
    kinds = list(kinds.values())
    units = [unit(vector(k[0])) for k in kinds]

    def near(v, k):
        met = sorted(((-round(sum(x * u.get(w, 0.0) for w, x in v.items()), 12), i) for i, u in enumerate(units)))
        return [(i, -c) for c, i in met[:k] if c < 0]

    share = (1 + n[1]) / (2 + sum(n))

    def vote(found, leave=None):
        votes = [sum(c**2 for i, c in found if i != leave for d in kinds[i] if learn[d] == k) for k in (0, 1)]
        return math.log((votes[1] + share) / (votes[0] + 1 - share))

    x, y = [], []
    for i, u in enumerate(units):
        v = vote(near(u, 16), i)
        x += [v] * len(kinds[i])
        y += [learn[d] for d in kinds[i]]
    slope, intercept = platt(np.array(x), np.array(y), np.ones(len(x)))
    bare = [sum(1 for d, z in learn.items() if z == k and not words[d]) + (1 + n[k]) / (2 + sum(n)) for k in (0, 1)]
    out = {}
    for d, _ in rows:
        v = vector(d)
        found = near(unit(v), 15) if v else []
        out[d] = (1 / (1 + math.exp(-(slope * vote(found) + intercept))) if found else bare[1] / sum(bare), found and found[0][1])
    return out


def test_toxicity_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 1500")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in dict(rows) and r.toxic is not None}
    want = brute_toxicity(rows, marks)
    got = score_toxicity(docs, labels.where(labels.doc_id.isin(list(marks)))).collect()
    assert len(got) == len(rows) > 300
    for r in got:
        score, cosine = want[r.doc_id]
        assert abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.5), r.doc_id
        assert abs((r.evidence[0].cosine if r.evidence else 0) - (cosine or 0)) < 1e-9


def plain_features(text):
    """The features of one text by plain string work."""
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + j for i in range(len(words) - 7) if places[tuple(words[i : i + 8])] > 1 for j in range(8)}
    number = lambda chars: sum(c in chars for c in text)
    counts = {
        "n_symbols": number("#*$%&|<>"),
        "n_repeat_words": len(again),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
        "n_marks": number("!?;:_=+/\\@^~{}[]()"),
        "n_stops": number(".,"),
        "n_lines": len(lines),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }
    n = len(words) + PRIOR
    rate = {c: math.log(OFFSET + counts[c] / n) for c in RATES}
    first = [math.log1p(len(words)), math.log((sum(map(len, words)) + 5 * PRIOR) / n), math.log((len(set(words)) + PRIOR) / n)]
    return [*first, math.log(OFFSET + (len(lines) - len(set(lines))) / (len(lines) + 5)), *rate.values(), float(len(words) < 20), rate["n_symbols"] * rate["n_upper"]]


def test_quality_equals_brute_force(spark):
    """Features by plain strings; the one weighting under which the loss over the pairs is flat; the best of all cuts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in texts}
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert sorted(got) == sorted(texts) and len(texts) == 1000
    ids = sorted(texts)
    x = np.array([plain_features(texts[d]) for d in ids])
    x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)
    assert x.shape[1] == len(FEATURES)
    ranks = np.array([got[d].rank_score for d in ids])
    w, *_ = np.linalg.lstsq(x, ranks, rcond=None)
    assert np.allclose(x @ w, ranks, atol=1e-6)  # the scores are linear in the plain features

    learn = [d for d in sorted(marks) if zlib.crc32(str(d).encode()) % 3 != 1]
    assert {d for d in ids if got[d].held_out} == {d for d in ids if zlib.crc32(str(d).encode()) % 3 == 1}
    place = {d: i for i, d in enumerate(ids)}
    y, seen = np.array([marks[d] for d in learn]), x[[place[d] for d in learn]]
    better, worse = pairs_of(y, PAIRS)
    assert set(better) == set(np.flatnonzero(y == 1)) and set(worse) == set(np.flatnonzero(y == 0))
    gap = seen[better] - seen[worse]
    slope = w - (gap / (1 + np.exp(gap @ w))[:, None]).sum(axis=0)  # of the strictly convex loss, zero at its only least
    assert np.abs(slope).max() < 1e-4

    tau = {round(r.rank_score - math.log(r.score / (1 - r.score)), 6) for r in got.values() if 1e-9 < r.score < 1 - 1e-9}
    assert len(tau) == 1
    tau = tau.pop()
    wrong = lambda cut: sum((s > cut) != k for s, k in zip(seen @ w, y == 1, strict=True))
    assert wrong(tau) == min(wrong(cut) for cut in [-math.inf, *(seen @ w + 1e-8)])
    for d in ids:
        r = got[d]
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, r.rank_score - tau))))
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.5)


def test_all_pairs_need_no_listing():
    """Loss, slope and second derivatives from sums at nodes, against every pair listed; scores near and far apart."""
    from wayline.llm.ranking import NODES, SPAN, moments, over_pairs

    rng = np.random.default_rng(8)
    nodes = (np.cos((np.arange(NODES) + 0.5) * np.pi / NODES) + 1) / 2
    for width in (0.0, 0.3, 3.0, 40.0):
        w = rng.normal(size=4) * width
        sides = [rng.normal(size=(n, 4)) + shift for n, shift in ((150, 0.0), (210, 0.4))]
        at, sums = zip(*(moments(x, x @ w) for x in sides), strict=True)
        loss, grad, hess = over_pairs([(SPAN * (a[:, None] + nodes)).ravel() for a in at], [m.reshape(-1, m.shape[2]) for m in sums], w)
        gap = (sides[1][:, None] - sides[0]).reshape(-1, 4)
        p = 1 / (1 + np.exp(gap @ w))
        assert np.isclose(loss, np.logaddexp(0, -gap @ w).sum() + w @ w / 2, rtol=1e-11)
        assert np.allclose(grad, w - p @ gap, rtol=0, atol=1e-9 * len(gap))
        assert np.allclose(hess, (gap * (p * (1 - p))[:, None]).T @ gap + np.eye(4), rtol=0, atol=1e-9 * len(gap))


def test_quality_learns_from_every_label(spark):
    """More labels than the 20,000 that once were the most: the loss over all pairs of them is flat, the cut the best of all."""
    rng = np.random.default_rng(5)
    words = ["plain", "Words", "of", "text.", "#", "12", "go", "go", "A|B", "line\n"]
    rows, marks = [], []
    for d in range(33_000):
        bad = d % 150 == 0
        picked = rng.choice(len(words), rng.integers(4, 12), p=[0.1] * 4 + [0.1] * 6 if bad else [0.18] * 4 + [0.28 / 6] * 6)
        rows.append((d, " ".join(words[i] for i in picked)))
        marks.append((d, int(not bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = np.array([(r.rank_score, r.score) for r in score_quality(docs, labels).orderBy("doc_id").collect()])
    x = np.array([plain_features(t) for _, t in rows])
    x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)
    y, learn = np.array([q for _, q in marks]), np.array([zlib.crc32(str(d).encode()) % 3 != 1 for d, _ in rows])
    assert (y[learn] == 1).sum() > 20_000 and (y[learn] == 0).sum() > 100
    moving = x.std(axis=0) > 0
    w = np.zeros(len(FEATURES))
    w[moving] = np.linalg.lstsq(x[:, moving], got[:, 0], rcond=None)[0]
    assert np.allclose(x @ w, got[:, 0], atol=1e-6)
    slope = w.copy()
    for bad in x[learn & (y == 0)]:
        gap = x[learn & (y == 1)] - bad
        slope -= (1 / (1 + np.exp(gap @ w))) @ gap
    assert np.abs(slope).max() < 1e-3  # the sum has millions of pairs

    order = np.argsort(got[learn, 0], kind="stable")
    s, k = got[learn, 0][order], y[learn][order]
    wrong = np.concatenate([[0], np.cumsum(2 * k - 1)]) + (k == 0).sum()
    apart = np.concatenate([[True], np.diff(s) > 1e-9, [True]])
    assert ((got[learn, 1] >= 0.5) != (y[learn] == 1)).sum() == wrong[apart].min()


def test_quality_cut_is_the_best_of_all(spark):
    """Many equal scores, ranges of scores in tasks of their own, several best cuts, best cuts at either end."""
    from wayline.llm.ranking import best_cut
    from wayline.llm.workspace import Workspace

    rng = np.random.default_rng(2)
    made = [[(int(rng.random() < s / 40 + 0.3), s * 0.5) for s in rng.integers(0, 12, 300).tolist()] for _ in range(2)]
    for rows in (*made, [(1, 1.0), (0, 2.0)], [(0, 1.0), (1, 2.0), (0, 3.0), (1, 4.0)], [(1, 3.0), (1, 3.0), (0, 3.0)], [(0, 1.0), (0, 1.0 + 1e-12), (1, 1.0 + 1e-12)]):
        s = sorted({x for _, x in rows})
        kept = [x for i, x in enumerate(s) if not i or x - s[i - 1] > 1e-9]
        under = {x: max((z for z in s if z < x), default=None) for x in kept}
        cuts = [(under[x] + x) / 2 if under[x] is not None else x - 1 for x in kept] + [s[-1] + 1]
        wrong = [sum((x > c) != bool(k) for k, x in rows) for c in cuts]
        best = [c for c, n in zip(cuts, wrong, strict=True) if n == min(wrong)]
        assert best_cut(spark.createDataFrame(rows, "y int, s double"), Workspace(spark)) == best[len(best) // 2]


def test_quality_of_repeated_ids(spark):
    """An id that repeats with other texts or labels is learned from once, the same way however rows are dealt."""
    rows = [(i, "plain words of text. " * (3 + i % 5) if i % 4 else "# | # 12 go go " * (2 + i % 3)) for i in range(200)]
    rows += [(i, "other text #" * 4) for i in range(0, 40)] * 3
    marks = [(i, int(i % 4 > 0)) for i in range(200)] + [(i, i % 2) for i in range(60)] + [(300, 1), (7, 5)]
    out = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows[::1 if n == 1 else -1], "doc_id long, text string").repartition(n)
        labels = spark.createDataFrame(marks[::1 if n == 1 else -1], "doc_id long, quality int").repartition(n)
        got = sorted((r.doc_id, round(r.rank_score, 7), round(r.score, 7)) for r in score_quality(docs, labels).collect())
        assert len(got) == len(rows)
        out.append(got)
    assert out[0] == out[1]
