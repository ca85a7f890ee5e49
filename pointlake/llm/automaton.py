"""Probabilistic automata inferred from examples by merging compatible prefix-tree states.

Examples are read into a prefix tree over classes of characters; each state counts the
classes that follow, the ends, and the characters themselves. States are merged if their
continuations could be draws from one distribution: frequencies of every class, and of
ends, differ by no more than Hoeffding's bound, and so do those of all states reached
from both. The bound is wide where counts are small, so that on a bare tree nearly all
states would match the first one they are held against. Hence two passes. The first
merges within a level only, each state with the nearest of the level's compatible ones;
counts add up, and constant prefixes, separators and lengths stay where they are. The
second holds states of different levels against each other, now with counts enough to
tell a loop from a format of fixed length, and merges only where both sides have EVIDENCE
examples; rarer states stay as they are.

A character's probability is its share among its state's characters, backed off to that
of its class (Witten and Bell), and a small part is left to all characters alike, so that
one odd character does not exclude a value.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

# The characters of credentials, and classes of them.
CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CLASSES = {"f": "abcdef", "z": "ghijklmnopqrstuvwxyz", "F": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"} | {c: c for c in "+/_=-."}
END = "$"

CLASS_OF = {c: k for k, chars in CLASSES.items() for c in chars}
PLACE = {c: i for i, c in enumerate(CHARACTERS)}
#: Hoeffding's error rate, examples a state needs to be merged across levels, and the share left to all characters.
ALPHA, EVIDENCE, ODD = 0.01, 20, 0.01
#: What a state's own characters say of its next one, at most; letters that the examples lack take part in the rest.
OWN = 0.9
#: States of a prefix tree at most; a tree ends at the last level that fits.
STATES = 1 << 15


def classes(value: str) -> str:
    """Characters as classes: a-f, other small letters, the same for capitals, digits, and each mark by itself."""
    return "".join(CLASS_OF.get(c, "z") for c in value)


class Automaton:
    """States with counts; merged states share a representative."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = []
        self.count: list[Counter] = []
        self.chars: list[Counter] = []
        self.depth: list[int] = []
        self.into: list[int] = []
        self.added(0)

    def added(self, depth: int) -> int:
        for field, value in ((self.next, {}), (self.count, Counter()), (self.chars, Counter()), (self.depth, depth), (self.into, len(self.into))):
            field.append(value)
        return len(self.into) - 1

    def find(self, state: int) -> int:
        while self.into[state] != state:
            self.into[state] = state = self.into[self.into[state]]
        return state

    def gap(self, a: int, b: int, alpha: float, evidence: int = 1) -> float | None:
        """The largest difference of frequencies of two states; None if they, or states reached from both, are not compatible."""
        bound, todo, seen, first = math.sqrt(0.5 * math.log(2 / alpha)), [(self.find(a), self.find(b))], set(), None
        while todo:
            pair = todo.pop()
            if pair in seen or pair[0] == pair[1]:
                continue
            seen.add(pair)
            a, b = pair
            ca, cb = self.count[a], self.count[b]
            n, m = ca.total(), cb.total()
            if first is None and min(n, m) < evidence:
                return None
            if not n or not m:
                continue
            far = max((abs(ca[c] / n - cb[c] / m) for c in ca.keys() | cb.keys()), default=0.0)
            if far > bound * (n**-0.5 + m**-0.5):
                return None
            first = far if first is None else first
            todo += [(self.find(t), self.find(self.next[b][c])) for c, t in self.next[a].items() if c in self.next[b]]
        return first or 0.0

    def join(self, a: int, b: int) -> None:
        """Make ``b`` and ``a`` one state, and with them what both lead to by the same class."""
        todo = [(a, b)]
        while todo:
            a, b = map(self.find, todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.count[a] += self.count[b]
            self.chars[a] += self.chars[b]
            self.depth[a] = min(self.depth[a], self.depth[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def reached(self) -> list[int]:
        """States from the start on, level by level, in a fixed order."""
        out, seen = [0], {0}
        for s in out:
            for c in sorted(self.next[s]):
                t = self.find(self.next[s][c])
                if t not in seen:
                    seen.add(t)
                    out.append(t)
        return out

    def merge_levels(self, alpha: float) -> None:
        level = [0]
        while level:
            below = sorted({self.find(t) for s in level for t in self.next[s].values()}, key=lambda s: (-self.count[s].total(), s))
            kept: list[int] = []
            for state in below:
                near = min(((g, k) for k in kept if (g := self.gap(k, state, alpha)) is not None), default=None)
                if near is None:
                    kept.append(state)
                else:
                    self.join(near[1], state)
            level = kept

    def merge_across(self, alpha: float, evidence: int) -> None:
        kept: list[int] = []
        for state in self.reached():
            if self.find(state) != state:
                continue
            home = next((k for k in kept if self.find(k) == k and self.gap(k, state, alpha, evidence) is not None), None)
            if home is None:
                kept.append(state)
            else:
                self.join(home, state)

    def merge_by_last(self) -> None:
        """Make states that the same class leads to one: what follows depends on the last class alone."""
        home: dict[str, int] = {}
        for state in self.reached():
            for c in sorted(self.next[state]):
                to = self.find(self.next[state][c])
                if c in home:
                    self.join(home[c], to)
                else:
                    home[c] = to

    def tables(self) -> "Tables":
        order = self.reached()
        place = {s: i for i, s in enumerate(order)}
        chances, follow = np.empty((len(order), len(CHARACTERS) + 1)), np.zeros((len(order), len(CHARACTERS)), np.int32)
        for i, s in enumerate(order):
            n, kinds, chars = self.count[s].total(), len(self.count[s]), self.chars[s]
            own = min(OWN, chars.total() / (chars.total() + len(chars))) if chars else 0.0
            share = {k: (self.count[s][k] + 0.5) / (n + 0.5 * (len(CLASSES) + 1)) for k in (*CLASSES, END)} if not kinds else {k: self.count[s][k] / n for k in (*CLASSES, END)}
            for c, j in PLACE.items():
                k = CLASS_OF[c]
                # of the class's share, the part that its characters have by themselves, the rest to all of the class alike
                among = sum(chars[x] for x in CLASSES[k])
                inside = own * (chars[c] / among if among else 1 / len(CLASSES[k])) + (1 - own) / len(CLASSES[k])
                chances[i, j] = (1 - ODD) * share[k] * inside + ODD / (len(CHARACTERS) + 1)
                follow[i, j] = place[self.find(self.next[s][k])] if k in self.next[s] else i
            chances[i, -1] = (1 - ODD) * share[END] + ODD / (len(CHARACTERS) + 1)
        return Tables(np.log(chances), follow)


class Tables:
    """An automaton as arrays: log probability of each character (and of an end) a state, and the state it leads to.

    A class that a state has not seen leaves the state as it is.
    """

    def __init__(self, chances: np.ndarray, follow: np.ndarray):
        self.chances, self.follow = chances.astype(np.float32), follow
        self.rows: list[list[float]] | None = None

    def __getstate__(self) -> tuple:
        return self.chances, self.follow

    def __setstate__(self, state: tuple) -> None:
        self.chances, self.follow = state
        self.rows = None

    def likelihood(self, places: list[int], ends: bool = True) -> float:
        """Log probability of a value given as places of its characters in CHARACTERS."""
        if self.rows is None:
            self.rows, self.steps = self.chances.tolist(), self.follow.tolist()
        state, total, rows, steps = 0, 0.0, self.rows, self.steps
        for c in places:
            total += rows[state][c]
            state = steps[state][c]
        return total + rows[state][-1] if ends else total


def infer(values: list[str], alpha: float = ALPHA, evidence: int = EVIDENCE, states: int = STATES, ends: bool = True, last: bool = False) -> Automaton:
    """The automaton of whole values; ``ends``: whether where values end is learned as well; ``last``: states are merged by the last class.

    The tree is made level by level; of values that go deeper than ``states`` states
    allow, the rest is counted along the merged automaton.
    """
    tree, depth = Automaton(), 0
    live = [(v, classes(v), 0) for v in sorted(values)]
    while live:
        for _, shape, state in live:
            if ends and len(shape) == depth:
                tree.count[state][END] += 1
        live = [x for x in live if len(x[1]) > depth]
        new = {(state, shape[depth]) for _, shape, state in live} - {(s, c) for _, _, s in live for c in tree.next[s]}
        if len(tree.into) + len(new) > states:
            break
        for i, (value, shape, state) in enumerate(live):
            c = shape[depth]
            tree.count[state][c] += 1
            tree.chars[state][value[depth]] += 1
            if c not in tree.next[state]:
                tree.next[state][c] = tree.added(depth + 1)
            live[i] = (value, shape, tree.next[state][c])
        depth += 1
    if last:
        tree.merge_by_last()
    else:
        tree.merge_levels(alpha)
        tree.merge_across(alpha, evidence)
    for value, shape, _ in live:
        state = 0
        for i, c in enumerate(shape):
            if i >= depth:
                tree.count[state][c] += 1
                tree.chars[state][value[i]] += 1
            if c in tree.next[state]:
                state = tree.find(tree.next[state][c])
        if ends:
            tree.count[state][END] += 1
    return tree
