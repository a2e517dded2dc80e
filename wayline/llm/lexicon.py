"""A minimal acyclic transducer from words to id lists, as flat arrays that tasks map into memory.

States whose right languages are equal are one state, so suffixes are shared. Each transition carries how many
words of the lexicon come before those that pass it; the sum along a path is the word's number, and numbers
lead to id lists. Transitions lie in a double array: state s goes by byte b to target[base[s] + b], if owner of
that cell is s.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Bases that are tried at once.
WINDOW = 2048
#: Kinds of arrays in a file, in this order.
PARTS = ("base", "final", "owner", "target", "passed", "first", "ids")


def minimal_states(words: list[bytes]) -> list[tuple[bool, tuple[int, ...], tuple[int, ...]]]:
    """(final, labels, targets) of the states of the minimal acyclic automaton of sorted distinct words; targets
    come before their sources, the start is last."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    path: list[list] = [[False, [], []]]  # of the last word: what may still change

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, labels, targets = path.pop()
            state = (final, tuple(labels), tuple(targets))
            if state not in known:
                known[state] = len(states)
                states.append(state)
            path[-1][2].append(known[state])

    last = b""
    for i, word in enumerate(words):
        if i and word <= last:
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        freeze(same)
        for b in word[same:]:
            path[-1][1].append(b)
            path.append([False, [], []])
        path[-1][0] = True
        last = word
    freeze(0)
    states.append(tuple(map(lambda x: x if isinstance(x, bool) else tuple(x), path[0])))
    return states


def double_array(states: list[tuple]) -> dict[str, np.ndarray]:
    """Arrays of the states: those with many transitions are placed first, each at the next base that fits."""
    counts = [0] * len(states)
    for s, (final, _, targets) in enumerate(states):
        counts[s] = final + sum(counts[t] for t in targets)
    cells = 2 * WINDOW + 2 * sum(len(labels) for _, labels, _ in states)
    owner, target, passed, taken = np.full(cells, -1, np.int32), np.zeros(cells, np.int32), np.zeros(cells, np.int32), np.zeros(cells, bool)
    base, least, reached = np.zeros(len(states), np.int32), 0, 0
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        final, labels, targets = states[s]
        if not labels:
            continue
        while taken[least : least + WINDOW].all():
            least += WINDOW
        # several transitions seldom fit into gaps before the last place found; single ones fill the gaps
        b = max(0, (reached if len(labels) > 1 else least) - labels[0])
        while True:
            if b + WINDOW + 256 > len(taken):  # all four grow alike
                owner, target, passed, taken = (np.concatenate([x, np.full(len(x), f, x.dtype)]) for x, f in ((owner, -1), (target, 0), (passed, 0), (taken, False)))
            fits = ~np.logical_or.reduce([taken[b + x : b + x + WINDOW] for x in labels])
            if fits.any():
                b += int(fits.argmax())
                break
            b += WINDOW
        base[s] = b
        if len(labels) > 1:
            reached = max(reached, b + labels[0])
        before = int(final)
        for label, t in zip(labels, targets, strict=True):
            taken[b + label] = True
            owner[b + label], target[b + label], passed[b + label] = s, t, before
            before += counts[t]
    end = int(np.flatnonzero(owner >= 0).max(initial=0)) + 257  # any base + byte is inside
    return {"base": base, "final": np.array([f for f, _, _ in states], np.int32), "owner": owner[:end], "target": target[:end], "passed": passed[:end]}


class Lexicon:
    """Look-up of many words at once; arrays may be maps of a file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.base, self.final, self.owner, self.target, self.passed, self.first, self.ids = (arrays[p] for p in PARTS)

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        arrays = double_array(minimal_states(words))
        sizes = [len(entries[w]) for w in words]
        arrays["first"] = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        arrays["ids"] = np.array([i for w in words for i in entries[w]], np.int32)
        return Lexicon(arrays)

    def to_bytes(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, p), np.int32) for p in PARTS]
        return np.concatenate([np.array([len(a) for a in arrays], np.int32), *arrays]).tobytes()

    @staticmethod
    def mapped(path: str) -> Lexicon:
        """The lexicon of a file, read only where it is used; workers of one machine share its pages."""
        whole = np.memmap(path, np.int32, "r")
        bounds = np.cumsum([len(PARTS), *whole[: len(PARTS)].tolist()])
        return Lexicon({p: whole[a:z] for p, a, z in zip(PARTS, bounds[:-1], bounds[1:], strict=True)})

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end], -1 if the lexicon hasn't it. All words take a step at a time."""
        out = np.full(len(starts), -1, np.int64)
        live, state, number, at = np.arange(len(starts)), np.full(len(starts), len(self.base) - 1), np.zeros(len(starts), np.int64), starts.copy()
        while len(live):
            over = at == ends[live]
            if over.any():
                ok = over & (self.final[state] == 1)
                out[live[ok]] = number[ok]
                on = ~over
                live, state, number, at = live[on], state[on], number[on], at[on]
            cell = self.base[state] + data[at]
            on = self.owner[cell] == state
            if not on.all():
                live, cell, number, at = live[on], cell[on], number[on], at[on]
            state, number, at = self.target[cell], number + self.passed[cell], at + 1
        return out

    def __contains__(self, word: bytes) -> bool:
        raw = np.frombuffer(word, np.uint8)
        return bool(self.numbers(raw, np.array([0]), np.array([len(raw)]))[0] >= 0)


def cut_for(counts: list[tuple[int, int]], most: int) -> int | None:
    """The least bin such that bins from it on hold at most `most` in all, of (bin, number) pairs; None if the
    highest bin holds more."""
    counts = sorted(counts, reverse=True)
    sums = np.cumsum([n for _, n in counts])
    fits = bisect_left(sums.tolist(), most + 1)
    return counts[fits - 1][0] if fits else None
