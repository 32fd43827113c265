"""Byte automata of regular expressions: subset construction, minimisation, transition arrays.

The expressions are literals of ASCII bytes, ``\\xHH`` and escaped characters, classes such as
``[A-Z0-9_]``, groups, ``|`` and the repeats ``? * + {n} {n,} {n,m}``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

_REPEATS = {"?": (0, 1), "*": (0, None), "+": (1, None)}


class BadPattern(ValueError):
    """An expression outside the language above."""


class _Reader:
    """Recursive descent over one expression; a node is a set of bytes, ('cat' | 'or', nodes) or ('rep', node, least, most)."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise BadPattern(f"{self.text!r} ends too early")
        self.at += 1
        return c

    def either(self):
        options = [self.row()]
        while self.peek() == "|":
            self.take()
            options.append(self.row())
        return options[0] if len(options) == 1 else ("or", options)

    def row(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, node):
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                least, comma, most = self.text[self.at : self.text.index("}", self.at)].partition(",")
                self.at = self.text.index("}", self.at) + 1
                bounds = int(least), (int(most) if most else None) if comma else int(least)
            else:
                bounds = _REPEATS[sign]
            node = ("rep", node, *bounds)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.either()
            if self.take() != ")":
                raise BadPattern(f"an open group in {self.text!r}")
            return node
        if c == "[":
            return self.charset()
        if c in "^$.*+?{":
            raise BadPattern(f"{c!r} in {self.text!r}")
        return self.folded({self.code(c)})

    def code(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
            if c.isalnum():
                raise BadPattern(f"\\{c} in {self.text!r}")
        if ord(c) > 127:
            raise BadPattern(f"{c!r} is no ASCII character")
        return ord(c)

    def charset(self):
        found = set()
        while self.peek() != "]":
            low = high = self.code(self.take())
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.code(self.take())
            found.update(range(low, high + 1))
        self.take()
        return self.folded(found)

    def folded(self, codes: set[int]) -> frozenset[int]:
        if self.fold:
            codes = codes | {ord(chr(c).swapcase()) for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(codes)


def parse(pattern: str, fold: bool = False):
    """The tree of an expression; ``fold`` takes ASCII letters in either case."""
    reader = _Reader(pattern, fold)
    node = reader.either()
    if reader.at < len(pattern):
        raise BadPattern(f"an extra ) in {pattern!r}")
    return node


def backwards(node):
    """The tree of the same texts read from their ends."""
    if isinstance(node, frozenset):
        return node
    if node[0] == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    parts = [backwards(x) for x in node[1]]
    return (node[0], parts[::-1] if node[0] == "cat" else parts)


class _Net:
    """A nondeterministic automaton grown from trees."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.edge: list[tuple[frozenset[int], int] | None] = []

    def node(self) -> int:
        self.free.append([])
        self.edge.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Put ``tree`` behind node ``start``; returns its last node."""
        if isinstance(tree, frozenset):
            fresh, end = self.node(), self.node()
            self.free[start].append(fresh)
            self.edge[fresh] = (tree, end)
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "or":
            end = self.node()
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.node()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.node()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def closure(self, nodes: Iterable[int]) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``step[state, classes[byte]]`` is the next state, ``accepts[state]`` has a bit for each tree; state 0 is the first, ``dead`` the one without a way out or -1."""

    classes: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    dead: int

    def resets(self) -> np.ndarray:
        """Whether a byte leads to the first state from every state, so that a text may be cut before it."""
        return (self.step == 0).all(axis=0)[self.classes]

    def longest(self, data: bytes, start: int, end: int) -> int:
        """Where the longest match that begins at ``start`` ends; -1 without one."""
        rows, classes, accepts, dead = self.rows()
        state, found = 0, start if accepts[0] else -1
        for at in range(start, end):
            state = rows[state][classes[data[at]]]
            if state == dead:
                break
            if accepts[state]:
                found = at + 1
        return found

    def rows(self):
        if not hasattr(self, "_rows"):
            object.__setattr__(self, "_rows", (self.step.tolist(), self.classes.tolist(), self.accepts.tolist(), self.dead))
        return self._rows


def determinise(trees: list, anywhere: bool = False) -> Automaton:
    """The minimal automaton of all ``trees`` at once; ``anywhere`` lets a match begin at every byte."""
    net = _Net()
    root = net.node()
    ends = {}
    for bit, tree in enumerate(trees):
        start = net.node()
        net.free[root].append(start)
        ends[net.add(tree, start)] = 1 << bit
    sets = {edge[0] for edge in net.edge if edge}
    member = np.array([[byte in s for byte in range(256)] for s in sets], bool).reshape(len(sets), 256)
    kinds, classes = np.unique(member, axis=1, return_inverse=True)
    one = {int(c): int(np.flatnonzero(classes.ravel() == c)[0]) for c in range(kinds.shape[1])}
    first = net.closure([root])
    known, todo, step, accepts = {first: 0}, [first], [], []
    while todo:
        here = todo.pop(0)
        accepts.append(sum({ends[n] for n in here if n in ends}))
        edges = [net.edge[n] for n in here if net.edge[n]]
        row = []
        for c in range(kinds.shape[1]):
            nodes = [to for codes, to in edges if one[c] in codes]
            there = net.closure([*nodes, root] if anywhere else nodes)
            if there not in known:
                known[there] = len(known)
                todo.append(there)
            row.append(known[there])
        step.append(row)
    return _minimised(classes.ravel().astype(np.uint8), np.array(step, np.int64), np.array(accepts, np.int64))


def _minimised(classes: np.ndarray, step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """States that no text tells apart made one, by refining the partition of what they accept."""
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)  # the first state's part becomes state 0
    _, heads = np.unique(part, return_index=True)
    order[part[np.sort(heads)]] = np.arange(len(heads))
    states = np.sort(heads)
    step, accepts = order[part[step[states]]].astype(np.int32), accepts[states]
    stuck = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(classes, step, accepts, int(stuck[0]) if len(stuck) else -1)
