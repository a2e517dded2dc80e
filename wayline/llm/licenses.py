"""License scans by token automata compiled from template markup."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, hash_word, text_chunks, word_hashes

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Template markup: <<beginOptional>> ... <<endOptional>> may be left out; <<var;name=..;match={lo,hi}>>
#: stands for lo to hi words of any wording. All other words are mandatory, in order. Signs and case are no
#: matter, as texts are read by words.
HOLDER = "<<beginOptional>>Copyright <<var;name=copyright;match={1,40}>><<endOptional>>"
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY <<var;name=party;match={2,20}>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL <<var;name=party;match={2,20}>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
BINARY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
LATER = "either version {0} of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version"
GPL = (
    "<<var;name=program;match={{2,12}}>> is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>;<<endOptional>> "
    + LATER
    + ". <<beginOptional>>This program<<endOptional>> <<beginOptional>><<var;name=program;match={{1,4}}>><<endOptional>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
TEMPLATES = {
    # whole texts
    "mit-text": "<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> <<beginOptional>>MIT License<<endOptional>> " + HOLDER
    + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL <<var;name=holders;match={2,20}>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "<<beginOptional>>ISC License<<endOptional>> " + HOLDER
    + " Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;name=author;match={1,10}>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL <<var;name=author;match={1,10}>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-text": "<<beginOptional>>BSD 2-Clause License<<endOptional>> " + HOLDER + " " + BINARY + " " + DISCLAIMER,
    "bsd-3-clause-text": "<<beginOptional>>BSD 3-Clause License<<endOptional>> " + HOLDER + " " + BINARY
    + " <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=owner;match={1,20}>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + DISCLAIMER,
    "zlib-text": HOLDER
    + " This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "<<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "<<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.",
    "apache-2.0-text": HOLDER
    + " Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use <<var;name=what;match={1,6}>> except in compliance with the License. You may obtain a copy of the License at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-text": GPL.format(2),
    "gpl-3.0-text": GPL.format(3),
    # notices of a line
    "mit-notice": "<<beginOptional>>this software is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT license",
    "apache-2.0-notice": "licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2.0 <<beginOptional>>(the \"License\") you may not use <<var;name=what;match={1,4}>> except in compliance with the License<<endOptional>>",
    "gpl-notice": "<<beginOptional>>this <<var;name=work;match={1,3}>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>lesser<<endOptional>> general public license <<beginOptional>>as published by the Free Software Foundation <<beginOptional>>either<<endOptional>><<endOptional>> version <<var;name=version;match={1,2}>>",
    "cc-by-nc-notice": "licensed under CC BY NC <<beginOptional>>SA<<endOptional>> <<var;name=version;match={1,2}>>",
    "cc-by-notice": "licensed under <<beginOptional>>a<<endOptional>> CC BY <<beginOptional>>SA<<endOptional>> 4.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def tokens(text: str) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


class Automaton:
    """A nondeterministic automaton over words: steps[s] = {word: {states}}, any_word[s] = {states}."""

    def __init__(self, template: str):
        self.steps: list[dict[str, set[int]]] = [{}]
        self.any_word: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.mandatory: list[str] = []
        opened, now, at = [], 0, 0
        for m in [*MARKUP.finditer(template), None]:
            for word in tokens(template[at : m.start() if m else None]):
                now = self._link(now, word)
                if not opened:
                    self.mandatory.append(word)
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(now)
            elif m[1] == "endOptional":
                self.free[opened.pop()].add(now)
            else:
                lo, hi = map(int, re.search(r"match=\{(\d+),(\d+)\}", m[1]).groups())
                ends = [now] if not lo else []
                for n in range(hi):
                    now = self._link(now, None)
                    if n + 1 >= lo:
                        ends.append(now)
                for e in ends:
                    if e != now:
                        self.free[e].add(now)
        if opened:
            raise ValueError("an optional region isn't closed")
        self.last = now
        self.start = self.closure({0})

    def _link(self, now: int, word: str | None) -> int:
        new = len(self.steps)
        self.steps.append({})
        self.any_word.append(set())
        self.free.append(set())
        (self.any_word[now] if word is None else self.steps[now].setdefault(word, set())).add(new)
        return new

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    def firsts(self) -> set[str] | None:
        """Words that an accepted run may begin with; None where that can be any."""
        return None if any(self.any_word[s] for s in self.start) else {w for s in self.start for w in self.steps[s]}

    def accepts(self, text: str) -> bool:
        """Whether the text as a whole is of the template's wording."""
        words = tokens(text)
        return self.longest(words, 0) == len(words)

    def longest(self, words: list[str], at: int) -> int:
        """End of the longest accepted run of words from `at`; -1 if there is none."""
        states, end = self.start, -1
        while True:
            if self.last in states:
                end = at
            if at == len(words) or not states:
                return end
            states = self.closure({t for s in states for t in self.steps[s].get(words[at], ())} | {t for s in states for t in self.any_word[s]})
            at += 1


class Scanner:
    """Compiled templates and phrases; a text's words are read only where a template's rarest word is."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.templates = {name: Automaton(t) for name, t in templates.items()}
        self.phrases = {tuple(p.split()): label for p, label in phrases.items()}
        # a text must have all mandatory words of a template; one that prose seldom has is looked for first
        plain = {"licensed", "released", "under", "the", "license", "of", "is", "by", "and", "in", "to", "are", "version", "public", "general", "2", "4", "0", "software", "permission", "free", "this", "you", "any", "use"}
        rare = ("merchantability", "redistributions", "misrepresented", "apache", "gnu")
        self.pivot = {n: next((w for w in (*(r for r in rare if r in a.mandatory), *a.mandatory) if w not in plain), a.mandatory[0]) for n, a in self.templates.items()}
        self.hashes = {w: np.uint64(hash_word(w)) for w in {*self.pivot.values(), *(w for p in self.phrases for w in p)}}

    def scan(self, data, offsets):
        """For each text of a chunk: n_words, places [(start, label)], accepted [(label, start, end)]."""
        low = LOWER[data]
        starts, ends, words, first = word_hashes(low, offsets, ALNUM)
        n = len(offsets) - 1
        places, accepted = [[] for _ in range(n)], [[] for _ in range(n)]
        word = lambda i: low[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")
        for phrase, label in self.phrases.items():
            hit = np.flatnonzero(words[: len(words) - len(phrase) + 1] == self.hashes[phrase[0]]) if len(words) >= len(phrase) else np.zeros(0, int)
            for k in range(1, len(phrase)):
                hit = hit[words[hit + k] == self.hashes[phrase[k]]]
            of = np.searchsorted(first, hit, "right") - 1
            for i, d in zip(hit.tolist(), of.tolist(), strict=True):
                if i + len(phrase) <= first[d + 1] and all(word(i + k) == w for k, w in enumerate(phrase)):
                    places[d].append((i - int(first[d]), label))
        wanted: dict[int, set[str]] = {}
        for name, pivot in self.pivot.items():
            hit = np.flatnonzero(words == self.hashes[pivot])
            for d in np.unique(np.searchsorted(first, hit, "right") - 1).tolist():
                wanted.setdefault(d, set()).add(name)
        for d, names in wanted.items():
            text = [word(i) for i in range(first[d], first[d + 1])]
            for name in sorted(names):
                a = self.templates[name]
                begin, last = a.firsts(), -1
                for i, w in enumerate(text):
                    if i >= last and (begin is None or w in begin):
                        end = a.longest(text, i)
                        if end > i:
                            accepted[d].append((name, i, end))
                            last = end
        return np.diff(first), places, accepted


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of every row.

    labels are those of the phrases found and the names of the templates accepted anywhere in the text.
    score is 1 with an accepted template, 0.5 with phrases alone, else 0. matches lists accepted word
    ranges (label, start, end), longest first-come runs without overlap by template. Null and empty texts
    have no words and no labels. Rows are judged one by one, so repeated and null ids are no matter; texts
    are read whole in chunks, a very long one by itself; columns other than doc_id and text aren't read.
    """
    made = (templates or TEMPLATES, phrases or PHRASES)

    def run(batches):
        scanner = Scanner(*made)
        for batch in batches:
            out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
            for _, _, data, offsets in text_chunks(batch.column(1)):
                counts, places, accepted = scanner.scan(data, offsets)
                for n, base, found in zip(counts.tolist(), places, accepted, strict=True):
                    at = [i for i, _ in base]
                    own = {label for _, label in base}
                    row = (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in found})), 1.0 if found else 0.5 if base else 0.0, [{"label": x, "start": a, "end": b} for x, a, b in found])
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
            longs = [pa.array(out[c], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
            match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(out["base_labels"], pa.string()), pa.array(out["labels"], pa.string()), pa.array(out["score"], pa.float64()), pa.array(out["matches"], match)], ["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, end: long>>")
