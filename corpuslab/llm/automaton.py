"""Byte automata: rule patterns to one minimal transition array, and scans with it.

Patterns use literals, ``\\xHH`` and ``\\c`` escapes, classes, groups, ``|``, ``?``, ``*``, ``+``
and ``{m,}``. That is all the rules need.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

MOST_RULES = 31  # their bits are 32-bit integers


@dataclass
class _States:
    """Non-deterministic automaton: edges by byte set, and edges without a byte."""

    edges: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def new(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def turned(self) -> _States:
        """The same states with every edge the other way round."""
        other = _States([[] for _ in self.edges], [[] for _ in self.edges])
        for a, edges in enumerate(self.edges):
            for on, b in edges:
                other.edges[b].append((on, a))
        for a, targets in enumerate(self.free):
            for b in targets:
                other.free[b].append(a)
        return other


class _Pattern:
    def __init__(self, pattern: str, states: _States, any_case: bool):
        self.text, self.at, self.states, self.any_case = pattern, 0, states, any_case

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def either(self) -> tuple[int, int]:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        begin, end = self.states.new(), self.states.new()
        for a, b in branches:
            self.states.free[begin].append(a)
            self.states.free[b].append(end)
        return begin, end

    def sequence(self) -> tuple[int, int]:
        begin = end = self.states.new()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.states.free[end].append(a)
            end = b
        return begin, end

    def repeated(self) -> tuple[int, int]:
        mark = self.at
        part = self.single()
        stop = self.at
        times = self.counts()
        if times is None:
            return part
        least, most = times
        begin = end = self.states.new()
        for k in range(max(least, 1)):
            if k:
                self.at = mark
                part = self.single()
                assert self.at == stop
            self.states.free[end].append(part[0])
            if k >= least:
                self.states.free[end].append(part[1])
            end = part[1]
        if most is None:
            self.states.free[part[1]].append(part[0])
        self.at = self.after
        return begin, end

    def counts(self) -> tuple[int, int | None] | None:
        """Repeats that follow: (0, 1), (0, None), (1, None) or (m, None)."""
        c, found = self.peek(), None
        if c in "?*+" and c:
            found = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            self.take()
        elif c == "{":
            close = self.text.index("}", self.at)
            body = self.text[self.at + 1:close]
            self.at = close + 1
            found = int(body.rstrip(",")), (None if body.endswith(",") else int(body))
        self.after = self.at
        return found

    def single(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            part = self.either()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text}")
            return part
        members = self.members() if c == "[" else {self.byte(c)}
        if self.any_case:
            members |= {ord(chr(b).swapcase()) for b in members if chr(b).isalpha() and b < 128}
        begin, end = self.states.new(), self.states.new()
        self.states.edges[begin].append((frozenset(members), end))
        return begin, end

    def byte(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                code = self.text[self.at:self.at + 2]
                self.at += 2
                return int(code, 16)
        return ord(c)

    def members(self) -> set[int]:
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.byte(c)
            if self.peek() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.take()
                found |= set(range(low, self.byte(self.take()) + 1))
            else:
                found.add(low)
        return found


@dataclass
class Automaton:
    """Transition array ``moves[state * classes + byte_class[byte]]``; state 0 begins, ``accepts`` has rule bits."""

    moves: np.ndarray
    byte_class: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def classes(self) -> int:
        return int(self.byte_class.max()) + 1


def compile_rules(patterns: list[tuple[str, bool]], backward: bool = False) -> Automaton:
    """Subset construction and minimisation of all (pattern, any_case) rules together.

    Matches begin at the first byte. With ``backward`` the automaton reads bytes from the last to
    the first, takes any byte as the end of a match and accepts where a match begins.
    """
    if len(patterns) > MOST_RULES:
        raise ValueError(f"{len(patterns)} rules; {MOST_RULES} share an automaton at most")
    states = _States()
    start = states.new()
    entries, final = [], {}
    for rule, (pattern, any_case) in enumerate(patterns):
        parser = _Pattern(pattern, states, any_case)
        begin, end = parser.either()
        if parser.at != len(pattern):
            raise ValueError(f"cannot read {pattern} from {parser.at}")
        first, last = (end, begin) if backward else (begin, end)
        entries.append(first)
        final[last] = rule
    if backward:
        states = states.turned()
    states.free[start] += entries
    byte_class, members = _byte_classes(states)

    def closure(found: set[int]) -> frozenset[int]:
        todo = list(found)
        while todo:
            for n in states.free[todo.pop()]:
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return frozenset(found)

    first = closure({start})
    again = first if backward else frozenset()
    # what each state reaches on each byte class, free edges included
    reach = [{k: frozenset().union(*hit) for k, sample in enumerate(members)
              if (hit := [closure({t}) for on, t in edges if sample in on])} for edges in states.edges]
    number, order, rows = {first: 0}, [first], []
    for subset in order:
        row = [set(again) for _ in members]
        for s in subset:
            for k, targets in reach[s].items():
                row[k] |= targets
        targets = [frozenset(x) for x in row]
        for target in targets:
            if target not in number:
                number[target] = len(order)
                order.append(target)
        rows.append([number[t] for t in targets])
    accepts = [sum(1 << final[s] for s in subset if s in final) for subset in order]
    return _minimal(np.array(rows), np.array(accepts), byte_class)


def _byte_classes(states: _States) -> tuple[np.ndarray, list[int]]:
    """Bytes that no rule tells apart share a class; also one byte of each class."""
    sets = {on for edges in states.edges for on, _ in edges}
    kinds: dict[tuple, list[int]] = defaultdict(list)
    for b in range(256):
        kinds[tuple(b in on for on in sets)].append(b)
    byte_class = np.zeros(256, np.int64)
    for c, bytes_ in enumerate(kinds.values()):
        byte_class[bytes_] = c
    return byte_class, [bytes_[0] for bytes_ in kinds.values()]


def _minimal(rows: np.ndarray, accepts: np.ndarray, byte_class: np.ndarray) -> Automaton:
    """Merge states that no continuation tells apart, by refining the partition until it holds."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        signature = np.column_stack([block, block[rows]])
        refined = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    swap = {int(block[0]): 0, 0: int(block[0])}
    block = np.array([swap.get(int(b), int(b)) for b in block])
    n = int(block.max()) + 1
    moves, accepted = np.zeros((n, rows.shape[1]), np.int64), np.zeros(n, np.int64)
    moves[block] = block[rows]
    accepted[block] = accepts
    stuck = [s for s in range(n) if (moves[s] == s).all() and not accepted[s]]
    return Automaton(moves.astype(np.int32).reshape(-1), byte_class.astype(np.int32), accepted, stuck[0] if stuck else -1)


FEW = 100  # with fewer ranges left, a plain loop over their bytes is faster
BLOCK = 1 << 20  # bytes that loop takes at a time


def match_starts(machine: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each byte, the bits of all rules with a match that begins there and ends in its byte range.

    ``machine`` reads backward. One pass over the bytes, the ranges side by side.
    """
    size = end - start
    order = np.argsort(-size, kind="stable")
    last, left = end[order], size[order]
    kind = machine.byte_class[data]
    n_kinds = machine.classes
    scaled = machine.moves * n_kinds
    seen_by_state = np.repeat(machine.accepts, n_kinds).astype(np.int32)
    state = np.zeros(len(order), np.int32)
    begins = np.zeros(len(data), np.int32)
    alive = np.searchsorted(-left, -np.arange(int(left[0]) + 1 if len(left) else 1), side="left")
    step = 0
    while len(left) and step < left[0] and alive[step] >= FEW:
        n = alive[step]
        at = last[:n] - 1 - step
        state[:n] = scaled[state[:n] + kind[at]]
        begins[at] = seen_by_state[state[:n]]
        step += 1
    if len(left) and step < left[0]:
        moves, bits = scaled.tolist(), seen_by_state.tolist()
        for i in range(alive[step]):
            s, first = int(state[i]), int(last[i] - left[i])
            for high in range(int(last[i]) - step, first, -BLOCK):
                at = high
                for k in kind[max(first, high - BLOCK):high][::-1].tolist():
                    at -= 1
                    s = moves[s + k]
                    if bits[s]:
                        begins[at] = bits[s]
    return begins


def longest_from(machine: Automaton, kinds: bytes, at: int, stop: int) -> dict[int, int]:
    """Ends of the longest matches that begin at ``at`` and end by ``stop``, by the bits of the rules
    that accept there: a rule's own end is the largest of those whose bits hold it."""
    moves, accepts, n_kinds, dead = _plain(machine)
    found, s = {}, 0
    for j in range(at, stop):
        s = moves[s * n_kinds + kinds[j]]
        if s == dead:
            break
        if accepts[s]:
            found[accepts[s]] = j + 1
    return found


def leftmost_longest(forward: Automaton, backward: Automaton, data: np.ndarray, start: np.ndarray,
                     end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin, rule, end) of the leftmost, longest matches in each of the byte ranges, which are in order.

    Those of one rule do not overlap. The backward pass says where matches begin; from there the
    forward automaton, which holds all rules as well, runs to their ends. It runs from no byte
    at which no rule matches, so the time is in proportion to the bytes and the matches.
    """
    begins = match_starts(backward, data, start, end)
    at = np.flatnonzero(begins)
    if len(at) == 0:
        return
    stop = end[np.searchsorted(end, at, side="right")]
    kinds = forward.byte_class.astype(np.uint8)[data].tobytes()
    free = [0] * MOST_RULES
    rules_of: dict[int, list[int]] = {}
    for a, bits, most in zip(at.tolist(), begins[at].tolist(), stop.tolist()):
        if bits not in rules_of:
            rules_of[bits] = [r for r in range(MOST_RULES) if bits >> r & 1]
        wanted = [r for r in rules_of[bits] if free[r] <= a]
        if wanted:
            ends = longest_from(forward, kinds, a, most)
            for r in wanted:
                free[r] = max(b for own, b in ends.items() if own >> r & 1)
                yield a, r, free[r]


def _plain(machine: Automaton) -> tuple[list[int], list[int], int, int]:
    if not hasattr(machine, "_lists"):
        machine._lists = machine.moves.tolist(), machine.accepts.tolist(), machine.classes, machine.dead
    return machine._lists
