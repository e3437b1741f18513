"""Regular expressions over bytes as minimal deterministic automata in transition arrays."""

from __future__ import annotations

from re import _constants as C
from re import _parser

import numpy as np


class Nfa:
    """Thompson's construction: per state, its empty moves and its moves (byte set, next)."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[np.ndarray, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def regex(self, pattern: bytes, start: int) -> int:
        """Adds a pattern that begins at `start`; returns the state at its end."""
        return self._all(_parser.parse(pattern), start)

    def _all(self, items, at: int) -> int:
        for op, arg in items:
            at = self._one(op, arg, at)
        return at

    def _one(self, op, arg, at: int) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
            end = self.state()
            self.moves[at].append((self._bytes(op, arg), end))
            return end
        if op is C.SUBPATTERN:
            return self._all(arg[3], at)
        if op is C.BRANCH:
            end = self.state()
            for branch in arg[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self._all(branch, begin)].append(end)
            return end
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, items = arg
            for _ in range(least):
                at = self._all(items, at)
            if most is C.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self._all(items, loop)].append(loop)
                return loop
            end = self.state()
            self.empty[at].append(end)
            for _ in range(most - least):
                at = self._all(items, at)
                self.empty[at].append(end)
            return end
        raise ValueError(f"not a regular operation here: {op}")

    @staticmethod
    def _bytes(op, arg) -> np.ndarray:
        out = np.zeros(256, bool)
        if op is C.ANY:
            out[:] = True
            out[10] = False
        elif op in (C.LITERAL, C.NOT_LITERAL):
            out[arg] = True
        else:
            for kind, x in arg:
                if kind is C.LITERAL:
                    out[x] = True
                elif kind is C.RANGE:
                    out[x[0] : x[1] + 1] = True
                elif kind is not C.NEGATE:
                    raise ValueError(f"not a byte class here: {kind}")
        return ~out if op is C.NOT_LITERAL or op is C.IN and arg[0][0] is C.NEGATE else out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """table[state, byte] is the next state; accepts[state] has bit r if rule r ends there. State 0 is the start.

    Subset construction over classes of bytes that no rule tells apart, then refinement to the coarsest partition that
    keeps accepts and moves. With `anywhere`, every rule may begin at every byte; without, the last state may be a dead one.
    """

    def __init__(self, patterns: list[bytes], anywhere: bool) -> None:
        nfa = Nfa()
        start = nfa.state()
        ends = []
        for p in patterns:
            begin = nfa.state()
            nfa.empty[start].append(begin)
            ends.append(nfa.regex(p, begin))
        sets = [np.zeros(256, bool), *(s for moves in nfa.moves for s, _ in moves)]
        _, first, kind = np.unique(np.array(sets).T, axis=0, return_index=True, return_inverse=True)
        kind = kind.ravel()
        initial = nfa.closure([start])
        numbers, todo, rows = {initial: 0}, [initial], []
        while len(rows) < len(todo):
            now = todo[len(rows)]
            row = []
            for b in first:
                then = {t for s in now for m, t in nfa.moves[s] if m[b]}
                then = nfa.closure(then | {start} if anywhere else then)
                if then not in numbers:
                    numbers[then] = len(todo)
                    todo.append(then)
                row.append(numbers[then])
            rows.append(row)
        moves = np.array(rows)
        accepts = np.array([sum(1 << r for r, e in enumerate(ends) if e in s) for s in todo])
        block = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:  # Moore's refinement
            finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        order = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}
        number = np.array([order[b] for b in block.tolist()])
        keep = np.unique(number, return_index=True)[1]
        self.accepts = accepts[keep]
        self.table = number[moves[keep]][:, kind].astype(np.int32)

    def longest(self, data: bytes, at: int, end: int) -> int:
        """The end of the longest match that begins at `at`, or -1."""
        state, best = 0, at if self.accepts[0] else -1
        rows, ok, dead = self._lists()
        for i in range(at, end):
            state = rows[state][data[i]]
            if ok[state]:
                best = i + 1
            elif dead[state]:
                break
        return best

    def _lists(self) -> tuple[list, list, list]:
        if not hasattr(self, "_rows"):
            self._rows = self.table.tolist()
            self._ok = (self.accepts > 0).tolist()
            self._dead = [not o and all(t == s for t in r) for s, (r, o) in enumerate(zip(self._rows, self._ok, strict=True))]
        return self._rows, self._ok, self._dead


class Scanner:
    """Which rules end somewhere in each stretch of text: one pass of a combined automaton over all bytes.

    Bytes that lead from every state to the start cut the text into stretches that no match crosses. Stretches are read side
    by side, one byte of each at a step, longest first; the few that are much longer are finished one at a time.
    """

    #: Fewer stretches than this at a step are faster one by one.
    NARROW = 150

    def __init__(self, patterns: list[bytes]) -> None:
        dfa = Dfa(patterns, anywhere=True)
        order = np.argsort(dfa.accepts > 0, kind="stable")  # accepting states last, the start first
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.accepts = dfa.accepts[order]
        self.table = (place[dfa.table[order]] << 8).astype(np.int32)  # states times 256, ready to be indexed with a byte
        self.flat = self.table.ravel()
        self.first = int((self.accepts == 0).sum()) << 8
        self.resets = (self.table == 0).all(axis=0)
        self.states = len(order)

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rule bits of the stretches that have a match; offsets are the rows' borders."""
        from .kernels import words

        starts, ends, _ = words(buf, offsets, ~self.resets)
        lens = ends - starts
        order = np.argsort(-lens, kind="stable")
        starts, ends, lens = starts[order], ends[order], lens[order]
        found = np.zeros(len(starts), np.int64)
        state = np.zeros(len(starts), np.int32)
        at = starts.copy()
        wide = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), side="right")  # stretches of each length or more
        t = 0
        while t < len(wide) and wide[t] >= self.NARROW:
            k = wide[t]
            s = self.flat[state[:k] + buf[at[:k]]]
            state[:k] = s
            at[:k] += 1
            hit = s >= self.first
            if hit.any():
                i = np.flatnonzero(hit)
                found[i] |= self.accepts[s[i] >> 8]
            t += 1
        if t < len(wide):
            rows = [[x >> 8 for x in r] for r in self.table.tolist()]
            bits = self.accepts.tolist()
            for i in range(wide[t]):
                s, got = int(state[i]) >> 8, 0
                for b in buf[at[i] : ends[i]].tobytes():
                    s = rows[s][b]
                    got |= bits[s]
                found[i] |= got
        some = np.flatnonzero(found)
        return starts[some], ends[some], found[some]
