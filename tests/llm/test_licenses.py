import re

import pytest

from wayline.llm.licenses import PHRASES, TEMPLATES, Automaton, scan_licenses, tokens

DIR = "/root/testdata/sf0.01"


def brute(text):
    words = tokens(text or "")
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def base(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


def test_base_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = scan_licenses(docs).collect()
    assert {r.doc_id: base(r) for r in rows} == {d: brute(t) for d, t in texts.items()}
    assert all(r.score == 1.0 for r in rows if r.n_base) and any("apache-2.0-notice" in r.labels for r in rows)
    assert all(r.score == 0.0 and r.labels == "" for r in rows if not r.n_base)


def test_optional_and_replaceable_regions():
    a = Automaton("copy <<beginOptional>>and <<beginOptional>>then<<endOptional>> use<<endOptional>> it <<var;name=x;match={0,2}>> freely")
    for text, ok in [("copy it freely", 1), ("copy and use it freely", 1), ("copy and then use it a b freely", 1), ("copy it a b c freely", 0), ("copy and it freely", 0), ("copy it", 0)]:
        assert (a.longest(text.split(), 0) == len(text.split())) == bool(ok), text
    with pytest.raises(ValueError):
        Automaton("a <<beginOptional>> b")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "MIT LICENSE mit license"), (None, "é Apache  License"), (5, "cc by " * 20000), (6, "Released under the MIT License."), (6, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    got = scan_licenses(docs).collect()
    assert sorted(map(str, map(base, got))) == sorted(str(brute(t)) for _, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[6].labels == "mit,mit-notice" and by[6].score == 1.0 and by[3].score == 0.5 and by[1].score == 0.0
    assert [(m.start, m.end) for m in by[6].matches] == [(0, 5)]
    assert scan_licenses(docs.limit(0)).count() == 0


def expression(template):
    """The template as a regular expression over words that end in blanks."""
    out = []
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<beginOptional>>":
            out.append("(?:")
        elif part == "<<endOptional>>":
            out.append(")?")
        elif part.startswith("<<var"):
            out.append(r"(?:\S+ )" + re.search(r"match=(\{\d+,\d+\})", part)[1])
        else:
            out += [re.escape(w) + " " for w in tokens(part)]
    return re.compile("(?:^|(?<= ))" + "".join(out))


MIT = """MIT License

Copyright (c) 2031 Ana Lima and others. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def bare(template, var):
    """A text of the template: optional regions left in, replaceable ones filled."""
    return re.sub(r"<<(begin|end)Optional>>", " ", re.sub(r"<<var[^>]*>>", var, template))


def test_whole_licenses_are_accepted_or_rejected():
    mit = Automaton(TEMPLATES["mit-text"])
    assert mit.accepts(MIT) and mit.accepts(MIT.replace("MIT License\n", "", 1)) and mit.accepts(MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "Ana Lima"))
    assert mit.accepts(MIT[MIT.index("Permission") :])
    for old, new in (("publish, ", ""), ("sell", "rent"), ("substantial", "large"), ("free of charge", "free of any charge"), ("NONINFRINGEMENT", "NONINFRINGEMENT ALWAYS")):
        assert not mit.accepts(MIT.replace(old, new)), old
    assert not mit.accepts(MIT + " as amended")
    for name, template in TEMPLATES.items():
        a = Automaton(template)
        text = bare(template, "some two words")
        assert a.accepts(text) or "match={1,2}" in template, name
        words = text.split()
        assert not a.accepts(" ".join(words[:-1])) and not a.accepts(text + " unless revoked") or name.endswith("notice"), name
    two, three = Automaton(TEMPLATES["bsd-2-clause-text"]), Automaton(TEMPLATES["bsd-3-clause-text"])
    long = bare(TEMPLATES["bsd-3-clause-text"], "the project")
    assert three.accepts(long) and not two.accepts(long)


def test_labels_equal_expressions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = [(10**6 + i, "before " + bare(t, "some two words") + " after") for i, t in enumerate(TEMPLATES.values())]
    extra += [(2 * 10**6, "x " + MIT), (2 * 10**6 + 1, MIT.replace("publish", "print")), (2 * 10**6 + 2, MIT + MIT)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    made = {n: expression(t) for n, t in TEMPLATES.items()}
    for r in scan_licenses(docs).join(docs, "doc_id").collect():
        text = "".join(w + " " for w in tokens(r.text or ""))
        own = {x for x in r.base_labels.split(",") if x}
        found = {n for n, e in made.items() if e.search(text)}
        assert r.labels == ",".join(sorted(own | found)), r.doc_id
        assert r.score == (1.0 if found else 0.5 if own else 0.0)
        assert all(Automaton(TEMPLATES[m.label]).longest(text.split()[m.start :], 0) == m.end - m.start for m in r.matches)
