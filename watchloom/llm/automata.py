"""Regular expressions as minimal deterministic automata over bytes, several expressions in one automaton.

Understands literals, character sets, groups, alternatives and repeats, which Python's own parser reads. All of these are
ASCII. A match is leftmost and longest, which for the rules of this package is what a backtracking engine finds.
"""

from __future__ import annotations

import re._parser as sre
from collections import defaultdict

import numpy as np


class Nfa:
    """Edges by state: (bytes, target); empty moves apart."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, tree, start: int, backward: bool, fold: bool) -> int:
        """Adds the states of a parsed expression behind ``start``; the last one is returned."""
        for op, arg in reversed(list(tree)) if backward else tree:
            name = str(op)
            if name in ("LITERAL", "IN"):
                found = frozenset(_bytes(name, arg, fold))
                end = self.state()
                self.edges[start].append((found, end))
                start = end
            elif name == "SUBPATTERN":
                start = self.build(arg[3], start, backward, fold or bool(arg[1] & sre.SRE_FLAG_IGNORECASE))
            elif name == "BRANCH":
                end = self.state()
                for part in arg[1]:
                    self.empty[self.build(part, start, backward, fold)].append(end)
                start = end
            elif name == "MAX_REPEAT":
                least, most, part = arg
                for _ in range(least):
                    start = self.build(part, start, backward, fold)
                if most == sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.build(part, loop, backward, fold)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.empty[start].append(end)
                    for _ in range(most - least):
                        start = self.build(part, start, backward, fold)
                        self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"{name} is not supported in a rule")
        return start

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(name: str, arg, fold: bool) -> set[int]:
    parts = [("LITERAL", arg)] if name == "LITERAL" else [(str(o), a) for o, a in arg]
    out: set[int] = set()
    for kind, a in parts:
        if kind == "LITERAL":
            out.add(a)
        elif kind == "RANGE":
            out.update(range(a[0], a[1] + 1))
        else:
            raise ValueError(f"{kind} is not supported in a set")
    if fold:
        out |= {ord(chr(b).swapcase()) for b in out if b < 128}
    if max(out) > 127:
        raise ValueError("rules are ASCII")
    return out


def compile_rules(rules: list[str], backward: bool = False, search: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(next state by state and byte, bit mask of the rules that accept by state); state 0 is the first.

    ``backward`` reads the text from its end. ``search`` lets a match begin anywhere; without it, a state from which
    nothing can be accepted is -1.
    """
    nfa, ends = Nfa(), {}
    first = nfa.state()
    for bit, rule in enumerate(rules):
        own = nfa.state()
        nfa.empty[first].append(own)
        ends[nfa.build(sre.parse(rule), own, backward, False)] = bit
    begin = nfa.closure([first])
    # Subset construction.
    number, todo, moves, accept = {begin: 0}, [begin], [], []
    while todo:
        states = todo.pop(0)
        accept.append(sum(1 << ends[s] for s in states if s in ends))
        by_byte: dict[int, set[int]] = defaultdict(set)
        for s in states:
            for found, target in nfa.edges[s]:
                for b in found:
                    by_byte[b].add(target)
        row = np.full(256, 0 if search else -1, dtype=np.int32)
        known: dict[frozenset[int], int] = {}
        for b, targets in by_byte.items():
            key = frozenset(targets)
            if key not in known:
                after = nfa.closure(targets) | (begin if search else frozenset())
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                known[key] = number[after]
            row[b] = known[key]
        moves.append(row)
    return minimise(np.array(moves), np.array(accept))


def minimise(moves: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges states that no text tells apart, by refining classes until none splits."""
    _, classes = np.unique(accept, return_inverse=True)
    while True:
        after = np.where(moves < 0, -1, classes[moves])
        _, finer = np.unique(np.column_stack([classes, after]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == classes.max():
            break
        classes = finer
    # The class of state 0 becomes state 0.
    names = np.full(classes.max() + 1, -1)
    names[classes[0]] = 0
    rest = [c for c in range(len(names)) if c != classes[0]]
    names[rest] = np.arange(1, len(names))
    classes = names[classes]
    picked = np.zeros(len(names), dtype=np.int64)
    picked[classes] = np.arange(len(classes))
    merged = moves[picked]
    return np.where(merged < 0, -1, classes[merged]), accept[picked]


def linked(moves: np.ndarray, accept: np.ndarray) -> list:
    """Rows that hold the following rows themselves, for a scan without arithmetic; at 256 stands the mask."""
    rows: list[list] = [[None] * 257 for _ in moves]
    for row, targets, mask in zip(rows, moves.tolist(), accept.tolist(), strict=True):
        row[:256] = [rows[t] if t >= 0 else None for t in targets]
        row[256] = mask
    return rows[0]


class Scanner:
    """Finds the matches of all rules: one pass from the end marks where matches start, runs from there find the ends."""

    def __init__(self, marks, runs) -> None:
        self.marks = linked(*marks)
        self.runs = [linked(*r) for r in runs]

    @staticmethod
    def tables(rules: list[str]):
        """What the scanner needs, computed once and small enough to travel with the tasks."""
        return compile_rules(rules, backward=True, search=True), [compile_rules([r]) for r in rules]

    def scan(self, data: bytes) -> list[list[tuple[int, int]]]:
        """By rule: the leftmost longest matches, none overlapping another of its rule."""
        row, starts = self.marks, []
        for back, b in enumerate(reversed(data)):
            row = row[b]
            if row[256]:
                starts.append((back, row[256]))
        found: list[list[tuple[int, int]]] = [[] for _ in self.runs]
        size, free = len(data), [0] * len(self.runs)
        for back, mask in reversed(starts):
            at = size - 1 - back
            for rule, run in enumerate(self.runs):
                if mask >> rule & 1 and at >= free[rule]:
                    state, end = run, at
                    for i in range(at, size):
                        state = state[data[i]]
                        if state is None:
                            break
                        if state[256]:
                            end = i + 1
                    free[rule] = end
                    found[rule].append((at, end))
        return found
