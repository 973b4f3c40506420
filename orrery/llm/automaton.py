"""One deterministic automaton for many byte grammars, run over many chunks of text in step.

A grammar is a regular expression over ASCII (literals, classes, groups, alternatives, repeats, (?i:...)) in two parts,
a head and the rest behind it; both ends are accepted, so an accept tells where a value begins or may end. The union of
all grammars, searched anywhere, becomes a table by the subset construction. Grammars may be exclusive: while one of
them is at or behind the end of its head, none of them begins. That is the longest match from the left, and keeps the table small.

``scan`` cuts a text into overlapping chunks, advances all of them by one byte with one table lookup, and returns where
which grammars end. A chunk starts in the overlap, by whose end it is in the right state unless a match began before
it; where it isn't, the chunk is run again from the state that its neighbour ended in. So matches of any length are found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

import numpy as np

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def width(expression: str) -> int:
    """The length of the shortest match."""
    return parser.parse(expression).getwidth()[0]


@dataclass(frozen=True)
class Grammar:
    """``opens`` and ``closes`` name what is reported at the end of the head and of the whole (None: nothing).

    ``bounded``: it may only start where no letter or digit stands before. ``exclusive``: see the module.
    """

    opens: str | None
    head: str
    rest: str = ""
    closes: str | None = None
    bounded: bool = False
    exclusive: bool = False


class Automaton:
    def __init__(self, grammars: list[Grammar]) -> None:
        names = [n for g in grammars for n in (g.opens, g.closes) if n]
        self.bit = {n: 1 << i for i, n in enumerate(dict.fromkeys(names))}
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[np.ndarray, int]]] = []
        anywhere, boundary, fresh = self._state(), self._state(), self._state()
        everything = np.ones(256, bool)
        self.moves[anywhere] += [(everything, anywhere), (~WORD, boundary), (~WORD, fresh)]
        final: dict[int, int] = {}
        deep: set[int] = set()
        for g in grammars:
            first, middle = self._build(*self._parsed(g.head))
            self.eps[fresh if g.exclusive else boundary if g.bounded else anywhere].append(first)
            if g.opens:
                final[middle] = final.get(middle, 0) | self.bit[g.opens]
            if g.rest:
                before = len(self.eps)
                start, last = self._build(*self._parsed(g.rest))
                self.moves[middle] += self._entry(start)
                final[last] = final.get(last, 0) | self.bit[g.closes]
                if g.exclusive:
                    deep.update([middle, *range(before, len(self.eps))])
        self._determinise({anywhere, boundary, fresh}, final, deep, self._close({fresh}))
        del self.eps, self.moves

    @staticmethod
    def _parsed(expression: str) -> tuple[list, bool]:
        tree = parser.parse(expression)
        return list(tree), bool(tree.state.flags & re.I)

    def _entry(self, start: int) -> list[tuple[np.ndarray, int]]:
        """The moves out of ``start``, so that a state before it isn't behind its head yet."""
        return [m for s in self._close({start}) for m in self.moves[s]]

    def _state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def _set(self, items: list, fold: bool) -> np.ndarray:
        out, negate = np.zeros(256, bool), False
        for op, arg in items:
            if op is K.NEGATE:
                negate = True
            elif op is K.LITERAL:
                out[arg] = True
            elif op is K.RANGE:
                out[arg[0] : arg[1] + 1] = True
            else:
                raise ValueError(f"{op} isn't supported")
        if fold:
            out[65:91] |= out[97:123]
            out[97:123] |= out[65:91]
        return ~out if negate else out

    def _build(self, nodes: list, fold: bool) -> tuple[int, int]:
        first = last = self._state()
        for op, arg in nodes:
            if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
                chars = self._set({K.LITERAL: [(op, arg)], K.NOT_LITERAL: [(K.NEGATE, None), (K.LITERAL, arg)], K.IN: arg, K.ANY: [(K.NEGATE, None), (K.LITERAL, 10)]}[op], fold)
                new = self._state()
                self.moves[last].append((chars, new))
                last = new
            elif op is K.SUBPATTERN:
                a, b = self._build(list(arg[3]), (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)
                self.eps[last].append(a)
                last = b
            elif op is K.BRANCH:
                new = self._state()
                for option in arg[1]:
                    a, b = self._build(list(option), fold)
                    self.eps[last].append(a)
                    self.eps[b].append(new)
                last = new
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                low, high, body = arg
                for _ in range(low):
                    a, b = self._build(list(body), fold)
                    self.eps[last].append(a)
                    last = b
                if high is K.MAXREPEAT:
                    a, b = self._build(list(body), fold)
                    new = self._state()
                    self.eps[last] += [a, new]
                    self.eps[b] += [a, new]
                    last = new
                elif high > low:
                    new = self._state()
                    for _ in range(high - low):
                        self.eps[last].append(new)
                        a, b = self._build(list(body), fold)
                        self.eps[last].append(a)
                        last = b
                    self.eps[last].append(new)
                    last = new
            else:
                raise ValueError(f"{op} isn't supported")
        return first, last

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.eps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _determinise(self, start: set[int], final: dict[int, int], deep: set[int], fresh: frozenset[int]) -> None:
        masks = np.array([m for moves in self.moves for m, _ in moves])
        columns, self.classes = np.unique(masks, axis=1, return_inverse=True)
        self.classes = self.classes.ravel().astype(np.uint8)
        n, at, rows = columns.shape[1], 0, []
        members = []
        for moves in self.moves:
            members.append([(np.flatnonzero(columns[at + i]), to) for i, (_, to) in enumerate(moves)])
            at += len(moves)
        first = self._close(start)
        number, todo, accepts = {first: 0}, [first], []
        for states in todo:
            accepts.append(sum({final[s] for s in states if s in final}))
            targets: list[set[int]] = [set() for _ in range(n)]
            for s in states:
                for chars, to in members[s]:
                    for c in chars:
                        targets[c].add(to)
            row = []
            for t in targets:
                closed = self._close(t)
                if not deep.isdisjoint(closed):
                    closed -= fresh
                if closed not in number:
                    number[closed] = len(number)
                    todo.append(closed)
                row.append(number[closed])
            rows.append(row)
        self.n_classes = n
        self.table = (np.array(rows, np.int32) * n).ravel()
        self.accept = np.repeat(np.array(accepts, np.int64), n)[:: n]

    def scan(self, text: bytes | np.ndarray, chunk: int = 2048, overlap: int = 320) -> tuple[np.ndarray, np.ndarray]:
        """(ends, masks): after byte ``ends[i]`` what the bits of ``masks[i]`` name ends; in order, each end once."""
        data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunk = min(chunk, max(64, len(data)))
        n = -(-len(data) // chunk)
        padded = np.full(overlap + n * chunk, 10, np.uint8)
        padded[overlap : overlap + len(data)] = data
        padded = self.classes[padded]
        windows = np.lib.stride_tricks.as_strided(padded, (n, chunk + overlap), (chunk, 1))
        steps = np.ascontiguousarray(windows.T)
        state = np.zeros(n, np.int32)
        base = np.arange(n, dtype=np.int64) * chunk - overlap
        hit = self.accept > 0
        ends, masks, entered = [], [], None
        for i in range(chunk + overlap):
            if i == overlap:
                entered = state
            state = self.table[state + steps[i]]
            if i >= overlap:
                row = state // self.n_classes
                found = np.flatnonzero(hit[row])
                if len(found):
                    ends.append(base[found] + i)
                    masks.append(self.accept[row[found]])
        again = self._again(entered, state, padded, overlap, chunk)
        if again:
            wrong = np.isin(np.concatenate(ends) // chunk, list(again)) if ends else None
            ends, masks = ([np.concatenate(ends)[~wrong]], [np.concatenate(masks)[~wrong]]) if ends else ([], [])
            for at, mask in again.values():
                ends.append(np.array(at, np.int64))
                masks.append(np.array(mask, np.int64))
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, masks = np.concatenate(ends), np.concatenate(masks)
        order = np.argsort(ends, kind="stable")
        keep = order[ends[order] < len(data)]
        return ends[keep], masks[keep]

    def _again(self, entered: np.ndarray, left: np.ndarray, classes: np.ndarray, overlap: int, chunk: int) -> dict[int, tuple[list[int], list[int]]]:
        """(ends, masks) of each chunk that was entered in another state than the chunk before it was left in."""
        out: dict[int, tuple[list[int], list[int]]] = {}
        if not (entered[1:] != left[:-1]).any():
            return out
        entered, left, table, accept = entered.tolist(), left.tolist(), memoryview(self.table), self.accept
        hit = bytes(accept > 0)
        for i in range(1, len(entered)):
            if entered[i] != left[i - 1]:
                state, at, mask = left[i - 1], [], []
                for j, c in enumerate(classes[overlap + i * chunk : overlap + (i + 1) * chunk].tobytes(), i * chunk):
                    state = table[state + c]
                    if hit[state // self.n_classes]:
                        at.append(j)
                        mask.append(int(accept[state // self.n_classes]))
                left[i] = state
                out[i] = at, mask
        return out
