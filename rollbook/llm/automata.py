"""Probabilistic automata inferred from labelled strings by state merging, and their likelihoods for many strings at once.

The samples' prefix tree is merged in two passes where the Hoeffding bound finds outgoing and final frequencies of two
states, and of all that follows them, compatible (the ALERGIA scheme). First states at the same distance from the start:
what the samples are too few to tell apart is one there. Then states at different distances, if both were passed by enough
samples: so a fixed length stays a chain of states, and a run of any length becomes a loop.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Characters of a credential, by class; an automaton that knows some of a class expects the others a little.
CLASSES = (b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"+/_.=-")
ALPHABET = b"".join(CLASSES)
#: Place in ALPHABET of each byte (len(ALPHABET) for any other), and class of each place.
CODE = np.array([ALPHABET.index(bytes([b])) if bytes([b]) in ALPHABET else len(ALPHABET) for b in range(256)], np.int64)
CLASS_OF = np.array([k for k, members in enumerate(CLASSES) for _ in members])
#: Samples that a state needs before it is merged with one at another distance.
EVIDENCE = 30
#: Longest string that is scored side by side with others; each longer one is walked alone.
SIDE_BY_SIDE = 256
#: Longest beginning that strings may share as a state of its own when states are counted.
LONGEST_PREFIX = 128


@dataclass(frozen=True)
class Automaton:
    """logp and after by [state, place in ALPHABET]: log-probability of a character, and the state that it leads to; final by state."""

    logp: np.ndarray
    after: np.ndarray
    final: np.ndarray

    def scores(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-likelihoods of the strings codes[start : start + size]."""
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        going = np.flatnonzero(sizes <= SIDE_BY_SIDE)
        for p in range(int(sizes[going].max(initial=0))):
            going = going[sizes[going] > p]
            c, s = codes[starts[going] + p], state[going]
            total[going] += self.logp[s, c]
            state[going] = self.after[s, c]
        for k in np.flatnonzero(sizes > SIDE_BY_SIDE):
            s, logp, after = 0, self.logp.tolist(), self.after.tolist()
            for c in codes[starts[k] : starts[k] + sizes[k]].tolist():
                total[k] += logp[s][c]
                s = after[s][c]
            state[k] = s
        return total + self.final[state]


class States:
    """A prefix tree whose states are merged: counts by state, and find() for the state that one has become."""

    def __init__(self, samples: list[bytes]) -> None:
        self.kids: list[dict[int, int]] = [{}]
        self.through, self.ends, self.became = [0], [0], [0]
        self.taken: list[Counter] = [Counter()]
        for s in samples:
            at = 0
            for c in s:
                self.through[at] += 1
                self.taken[at][c] += 1
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.became.append(len(self.kids))
                    self.kids.append({})
                    self.taken.append(Counter())
                    self.through.append(0)
                    self.ends.append(0)
                at = self.kids[at][c]
            self.through[at] += 1
            self.ends[at] += 1

    @classmethod
    def counted(cls, counts: dict[tuple[bytes | int, int], int], far: int) -> tuple[States, dict[bytes | int, int]]:
        """States from counts of a character (-1: the end) in a state, and the states' numbers by their keys, as count_states has them."""
        out = cls([])
        keys = [b"", *sorted({k for k, _ in counts} - {b""}, key=lambda k: (len(k), 0, k) if isinstance(k, bytes) else (k, 1, b""))]
        number = {k: i for i, k in enumerate(keys)}
        out.kids, out.taken = [{} for _ in keys], [Counter() for _ in keys]
        out.through, out.ends, out.became = [0] * len(keys), [0] * len(keys), list(range(len(keys)))
        for (k, c), n in sorted(counts.items(), key=lambda x: (number[x[0][0]], x[0][1])):
            a = number[k]
            out.through[a] += n
            if c < 0:
                out.ends[a] += n
                continue
            out.taken[a][c] += n
            longer = k + bytes([c]) if isinstance(k, bytes) else None
            out.kids[a][c] = number[longer if longer in number else min(far, 1 + (len(k) if isinstance(k, bytes) else k))]
        return out, number

    def rests(self, samples: list[bytes]) -> dict[int, Counter]:
        """By state, how often so many characters of the samples follow it."""
        rest: dict[int, Counter] = {}
        for s in samples:
            a = self.find(0)
            for left, c in zip(range(len(s), -1, -1), [*s, None], strict=True):
                rest.setdefault(a, Counter())[left] += 1
                a = self.next(a, c) if c is not None else a
        return rest

    def find(self, a: int) -> int:
        while self.became[a] != a:
            self.became[a] = self.became[self.became[a]]
            a = self.became[a]
        return a

    def next(self, a: int, c: int) -> int | None:
        return self.find(self.kids[a][c]) if c in self.kids[a] else None

    def compatible(self, a: int, b: int, bound: float, least: int = 0) -> bool:
        """Whether a and b, and what follows both, pass the Hoeffding bound; states of under least samples pass it."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = pair = todo.pop()
            if a == b or pair in seen:
                continue
            seen.add(pair)
            n, m = self.through[a], self.through[b]
            if min(n, m) < max(1, least):
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if abs(self.taken[a][c] / n - self.taken[b][c] / m) > most:
                    return False
                if c in self.kids[a] and c in self.kids[b]:
                    todo.append((self.next(a, c), self.next(b, c)))
        return True

    def fold(self, a: int, b: int) -> None:
        """b becomes a, and so on with what follows the same character, so that one state follows each."""
        todo = [(a, b)]
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b:
                continue
            self.became[b] = a
            self.through[a] += self.through[b]
            self.ends[a] += self.ends[b]
            self.taken[a].update(self.taken[b])
            for c, k in self.kids[b].items():
                if c in self.kids[a]:
                    todo.append((self.kids[a][c], k))
                else:
                    self.kids[a][c] = k

    def followers(self, a: int) -> list[int]:
        return sorted({self.next(a, c) for c in self.kids[a]}, key=lambda k: (-self.through[k], k))

    def merge_levels(self, bound: float) -> list[int]:
        """Merges states of the same distance from the start; the states that are left."""
        level, out, done = [0], [], set()
        while level:
            out += level
            done.update(level)
            groups: list[int] = []
            for k in sorted({k for a in level for k in self.followers(a)}, key=lambda k: (-self.through[k], k)):
                if k != self.find(k) or k in done:
                    continue
                for g in groups:
                    if self.compatible(g, k, bound):
                        self.fold(g, k)
                        break
                else:
                    groups.append(k)
            level = list(dict.fromkeys(self.find(g) for g in groups))
        return out

    def merge_runs(self, bound: float, rest: dict[int, Counter]) -> list[int]:
        """Merges states of different distances that EVIDENCE samples passed, red against blue; the states that are left."""

        def same_rest(a: int, b: int) -> bool:
            """Whether the numbers of characters that follow are compatible: far cheaper to see than all states that follow."""
            x, y, d, most = rest[a], rest[b], 0.0, 0.0
            n, m = sum(x.values()), sum(y.values())
            for left in sorted(x.keys() | y.keys()):
                d += x[left] / n - y[left] / m
                most = max(most, abs(d))
            return most <= bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

        red = [0]
        while blue := [k for r in red for k in self.followers(r) if k not in red]:
            b = max(blue, key=lambda k: (self.through[k], -k))
            for r in red:
                if min(self.through[r], self.through[b]) >= EVIDENCE and same_rest(r, b) and self.compatible(r, b, bound, EVIDENCE):
                    rest[r] = rest[r] + rest[b]
                    self.fold(r, b)
                    break
            else:
                red.append(b)
            red = list(dict.fromkeys(self.find(r) for r in red))
        return red


def count_states(values: list[bytes], frequent: set[bytes], far: int) -> tuple[Counter, Counter]:
    """Of values over ALPHABET: counts of (state key, character or -1) and of (state key, characters that follow, far at most).

    The key of a beginning is itself if it is frequent, else its length, but no more than far: rare states are one at each
    distance, and all beyond far are one.
    """
    taken, rest = Counter(), Counter()
    for v in values:
        known = True
        for d, c in enumerate([*v, -1]):
            known = known and d <= LONGEST_PREFIX and (not d or v[:d] in frequent)
            k = v[:d] if known else min(d, far)
            taken[k, c] += 1
            rest[k, min(len(v) - d, far)] += 1
    return taken, rest


def infer(samples: list[bytes], alpha: float = 0.05) -> Automaton:
    """The automaton of a list of strings over ALPHABET (other characters end a string's use): merged states, then smoothed."""
    samples = [s for s in samples if s and all(c in ALPHABET for c in s)]
    states, bound = States(samples), math.sqrt(0.5 * math.log(2 / alpha))
    states.merge_levels(bound)
    return smoothed(states, states.merge_runs(bound, states.rests(samples)), np.bincount(CODE[np.frombuffer(b"".join(samples), np.uint8)], minlength=len(ALPHABET)), len(samples))


def infer_counted(taken: Counter, rest: Counter, far: int, alpha: float = 0.05) -> Automaton:
    """infer from the counts that count_states gives, summed over any number of strings."""
    states, number = States.counted(taken, far)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    states.merge_levels(bound)
    rests: dict[int, Counter] = {}
    for (k, left), n in rest.items():
        rests.setdefault(states.find(number[k]), Counter())[left] += n
    seen = np.zeros(len(ALPHABET) + 1)
    np.add.at(seen, CODE[[c for _, c in taken if c >= 0]], [n for (_, c), n in taken.items() if c >= 0])
    return smoothed(states, states.merge_runs(bound, rests), seen, sum(n for (_, c), n in taken.items() if c < 0))


def smoothed(states: States, left: list[int], seen: np.ndarray, ends: int) -> Automaton:
    """The automaton of the states that are left.

    A state that has seen D different continuations n times leaves D / (n + D) to the ones it has not seen, dealt by the
    characters of all samples, and a little to the rest of their classes and of ALPHABET. A character never seen in a
    state leads where most of its samples went on.
    """
    number = {a: k for k, a in enumerate(left)}
    size = len(ALPHABET)
    seen = seen[:size].astype(float)
    by_class = np.bincount(CLASS_OF, seen)[CLASS_OF] / np.bincount(CLASS_OF)[CLASS_OF]
    total, ends = max(1.0, seen.sum()), float(ends)
    usual = (0.97 * seen + 0.025 * by_class + 0.005 * total / size) / (total + ends)
    usual_end = max(ends, 0.5) / (total + ends) if total + ends else 0.5
    logp, after, final = np.zeros((len(left), size)), np.zeros((len(left), size), np.int64), np.zeros(len(left))
    for a, k in number.items():
        count = np.zeros(size)
        for c, n in states.taken[a].items():
            count[CODE[c]] = n
        n, kinds = states.through[a], int((count > 0).sum()) + (states.ends[a] > 0)
        kinds = max(1, kinds)
        logp[k] = np.log((count + kinds * usual) / (n + kinds))
        final[k] = math.log((states.ends[a] + kinds * usual_end) / (n + kinds))
        follow = states.followers(a)
        after[k] = number[max(follow, key=lambda x: sum(m for c, m in states.taken[a].items() if states.next(a, c) == x))] if follow else k
        for c in states.kids[a]:
            after[k, CODE[c]] = number[states.next(a, c)]
    return Automaton(logp, after, final)


@dataclass(frozen=True)
class Chain:
    """What is ordinary: log-probability of a class after a class (or at the start) and of a character in it, [class + 1, place]."""

    logp: np.ndarray

    def scores(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        before = np.concatenate(([0], 1 + CLASS_OF[codes[:-1]]))
        before[starts] = 0
        sums = np.concatenate(([0.0], np.cumsum(self.logp[before, codes])))
        return sums[starts + sizes] - sums[starts]


def class_pairs(values: list[bytes]) -> np.ndarray:
    """How often a class follows a class (or the start) in strings over ALPHABET, [class + 1, class]."""
    k = len(CLASSES)
    codes, starts, sizes = joined(values)
    after = CLASS_OF[codes]
    before = np.concatenate(([0], 1 + after[:-1])) if len(after) else after
    before[starts[sizes > 0]] = 0
    return np.bincount(before * k + after, minlength=(k + 1) * k).reshape(k + 1, k)


def chain(values: list[bytes]) -> Chain:
    """The chain of a list of strings over ALPHABET, with add-one counts."""
    return chain_counted(class_pairs(values))


def chain_counted(pairs: np.ndarray) -> Chain:
    """The chain of class_pairs, summed over any number of strings."""
    pairs = 1.0 + pairs
    logs = np.log(pairs / pairs.sum(axis=1, keepdims=True)) - np.log(np.bincount(CLASS_OF))
    return Chain(logs[:, CLASS_OF])


def joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of strings over ALPHABET one after the other, their starts and sizes."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return CODE[np.frombuffer(b"".join(values), np.uint8)], np.cumsum(sizes) - sizes, sizes
