"""Regular expressions over bytes as one deterministic automaton in transition arrays.

Supported: literals, escapes (``\\xHH``, ``\\.``), classes with ranges, groups, ``(?i:...)`` for ASCII letters,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Reader:
    """Turns a pattern into nested tuples: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.p[self.i]
        self.i += 1
        return c

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, item):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                body = self.p[self.i:self.p.index("}", self.i)]
                self.i += len(body) + 1
                low, _, high = body.partition(",")
                least, most = int(low), (int(high) if high else None) if "," in body else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            item = ("rep", item, least, most)
        return item

    def atom(self):
        c = self.take()
        if c == "(":
            outer = self.fold
            if self.p.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            item = self.alternatives()
            self.take()
            self.fold = outer
            return item
        if c == "[":
            return ("set", self.folded(self.members()))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c == "\\":
            return ("set", self.folded({self.escaped()}))
        return ("cat", [("set", self.folded({b})) for b in c.encode()])

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2:self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c) or ord(c)

    def members(self) -> set[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        out: set[int] = set()
        while self.peek() != "]":
            low = self.escaped() if (c := self.take()) == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                high = self.escaped() if (c := self.take()) == "\\" else ord(c)
                out |= set(range(low, high + 1))
            else:
                out.add(low)
        self.take()
        return set(range(256)) - out if negated else out

    def folded(self, members) -> frozenset[int]:
        if self.fold:
            members = members | {b ^ 32 for b in members if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(members)


class _Graph:
    """Nondeterministic automaton: free moves and moves on a set of bytes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Build ``tree`` from ``start``; the node in which it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.on[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.node()
        if kind == "or":
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
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.add(part, start)
                self.free[start].append(end)
        return end

    def closure(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state, classes[byte]]`` is the next state; 0 is the start; ``accepts[state]``; ``dead`` has no way out (-1: none)."""

    table: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_patterns(patterns: list[str], search: bool) -> Automaton:
    """Subset construction over all patterns together, then minimisation.

    ``search``: a match may start anywhere and, once one of them has matched, the automaton stays in its accepting
    state. Otherwise a match starts at the first byte and acceptance tells that it may end here.
    """
    g = _Graph()
    start = g.node()
    ends = {g.add(_Reader(p).alternatives(), start) for p in patterns}
    sets = sorted({s for moves in g.on for s, _ in moves}, key=sorted)
    code = np.zeros(256, np.int64)  # bytes that no set tells apart share a class
    for s in sets:
        member = np.isin(np.arange(256), sorted(s))
        code = np.unique(code * 2 + member, return_inverse=True)[1]
    first_of = [int(np.flatnonzero(code == k)[0]) for k in range(code.max() + 1)]

    begin = g.closure([start])
    hit = "hit"
    order, todo, rows = {begin: 0}, [begin], []
    while todo:
        nodes = todo.pop(0)
        row = []
        for b in first_of:
            if nodes == hit:
                to = hit
            else:
                to = g.closure({n for x in nodes for s, n in g.on[x] if b in s} | ({start} if search else set()))
                if search and to & ends:
                    to = hit
            if to not in order:
                order[to] = len(order)
                todo.append(to)
            row.append(order[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([s == hit if search else bool(s & ends) for s in order])

    group = accepts.astype(np.int64)  # states stay together while all their moves lead to equal groups
    while True:
        refined = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == group.max():
            break
        group = refined
    rank = np.full(group.max() + 1, -1)
    number = 0
    for k in group:  # the start keeps number 0
        if rank[k] < 0:
            rank[k], number = number, number + 1
    group = rank[group]
    some = np.unique(group, return_index=True)[1]
    small, ok = group[table[some]], accepts[some]
    stuck = [s for s in range(len(small)) if not ok[s] and (small[s] == s).all()]
    return Automaton(small.astype(np.int32), code.astype(np.uint8), ok, stuck[0] if stuck else -1)


def used_bytes(patterns: list[str]) -> np.ndarray:
    """Which bytes any part of any pattern can match; every other byte ends all matches."""
    g = _Graph()
    for p in patterns:
        g.add(_Reader(p).alternatives(), g.node())
    used = np.zeros(256, bool)
    for moves in g.on:
        for s, _ in moves:
            used[sorted(s)] = True
    return used


def cut(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, step: int = 256) -> np.ndarray:
    """Starts of pieces of about ``step`` bytes: every text's start, and bytes at which no match can be under way."""
    possible = np.flatnonzero(breaks[data])
    wanted = np.arange(step, len(data), step)
    at = np.searchsorted(possible, wanted)
    return np.unique(np.concatenate([offsets[:-1], possible[at[at < len(possible)]]]))


def run(auto: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Last state of each piece. Pieces advance side by side, one byte each step; the few longest go on alone."""
    width = auto.table.shape[1]
    flat, codes = auto.table.ravel() * width, auto.classes[data]
    order = np.argsort(starts - ends, kind="stable")
    at, sizes = starts[order], (ends - starts)[order]
    state = np.zeros(len(order), np.int32)
    done = 0
    alive = len(order) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
    for k in alive:
        if k < 48:
            break
        state[:k] = flat[state[:k] + codes[at[:k]]]
        at[:k] += 1
        done += 1
    table = flat.tolist()
    for j in range(len(order)):
        if sizes[j] <= done:
            break
        s = int(state[j])
        for c in codes[at[j]:at[j] + sizes[j] - done].tolist():
            s = table[s + c]
        state[j] = s
    out = np.empty(len(order), np.int32)
    out[order] = state // width
    return out


def matches(auto: Automaton, piece: bytes) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of an anchored automaton, tried from each byte that can start one."""
    width = auto.table.shape[1]
    table, codes, ok, dead = auto.table.ravel().tolist(), auto.classes.tolist(), auto.accepts.tolist(), auto.dead
    out, i, n = [], 0, len(piece)
    while i < n:
        s, j, end = 0, i, -1
        while j < n and (s := table[s * width + codes[piece[j]]]) != dead:
            j += 1
            if ok[s]:
                end = j
        if end > i:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out
