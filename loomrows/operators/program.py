"""Patterns as programs: instructions for an ordered-choice search, and a
deterministic automaton for patterns whose rows carry one label at most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.ast import Alt, Anchor, Empty, Exclude, Pattern, QueryError, Repeat, Seq, Var

ROW, SPLIT, JUMP, START, END, OUT, IN, MARK, CHECK, MATCH = range(10)
#: Instructions of a program, and states of an automaton.
MAX_PROGRAM, MAX_STATES = 50_000, 5_000
#: Rows that the native matcher takes at once.
MAX_TEXT = 1 << 29


class PatternLimitError(QueryError):
    """The pattern unfolds to too many instructions."""


def nullable(p: Pattern) -> bool:
    """Whether p can match no rows."""
    if isinstance(p, Var):
        return False
    if isinstance(p, Seq):
        return all(map(nullable, p.items))
    if isinstance(p, Alt):
        return any(map(nullable, p.items))
    if isinstance(p, Repeat):
        return p.least == 0 or nullable(p.item)
    if isinstance(p, Exclude):
        return nullable(p.item)
    return True


def variables(p: Pattern) -> list[str]:
    """Names in order of their first appearance."""
    if isinstance(p, Var):
        return [p.name]
    items = p.items if isinstance(p, (Seq, Alt)) else (p.item,) if isinstance(p, (Repeat, Exclude)) else ()
    return list(dict.fromkeys(v for i in items for v in variables(i)))


def has(p: Pattern, kind: type) -> bool:
    items = p.items if isinstance(p, (Seq, Alt)) else (p.item,) if isinstance(p, (Repeat, Exclude)) else ()
    return isinstance(p, kind) or any(has(i, kind) for i in items)


class Program:
    """code: (op, a, b) with a, b as the op has them."""

    def __init__(self, pattern: Pattern, label: dict[str, int]):
        self.label, self.code, self.marks = label, [], 0
        self._emit(pattern)
        self.code.append((MATCH, 0, 0))

    def _add(self, op: int, a: int = 0, b: int = 0) -> int:
        if len(self.code) >= MAX_PROGRAM:
            raise PatternLimitError("the pattern unfolds to too many instructions")
        self.code.append((op, a, b))
        return len(self.code) - 1

    def _split(self, at: int, inside: int, outside: int, greedy: bool) -> None:
        self.code[at] = (SPLIT, inside, outside) if greedy else (SPLIT, outside, inside)

    def _emit(self, p: Pattern) -> None:
        code = self.code
        if isinstance(p, Var):
            self._add(ROW, self.label[p.name])
        elif isinstance(p, Seq):
            for i in p.items:
                self._emit(i)
        elif isinstance(p, Anchor):
            self._add(END if p.end else START)
        elif isinstance(p, Exclude):
            self._add(OUT)
            self._emit(p.item)
            self._add(IN)
        elif isinstance(p, Alt):
            ends = []
            for i in p.items[:-1]:
                at = self._add(SPLIT)
                self._emit(i)
                ends.append(self._add(JUMP))
                self._split(at, at + 1, len(code), True)
            self._emit(p.items[-1])
            for e in ends:
                code[e] = (JUMP, len(code), 0)
        elif isinstance(p, Repeat):
            for _ in range(p.least):
                self._emit(p.item)
            if p.most is None:
                at, mark = self._add(SPLIT), None
                if nullable(p.item):
                    mark = self.marks
                    self.marks += 1
                    self._add(MARK, mark)
                self._emit(p.item)
                if mark is not None:
                    self._add(CHECK, mark, len(code) + 2)
                self._add(JUMP, at)
                self._split(at, at + 1, len(code), p.greedy)
            else:
                ats = []
                for _ in range(p.most - p.least):
                    ats.append(self._add(SPLIT))
                    self._emit(p.item)
                for at in ats:
                    self._split(at, at + 1, len(code), p.greedy)
        elif not isinstance(p, Empty):
            raise QueryError(f"unknown pattern {p!r}")


class Automaton:
    """Runs a program over symbols: a row's only label, ``none`` for rows
    without one, ``none + 1`` between partitions. ``forward`` finds where the
    leftmost preferred match ends, ``back`` where it starts. States are made as
    they are met. For programs of ROW, SPLIT and JUMP that match no empty row."""

    def __init__(self, pattern: Pattern, label: dict[str, int]):
        self.none = len(label)
        self.width = self.none + 2
        self.code = Program(pattern, label).code
        if any(op not in (ROW, SPLIT, JUMP, MATCH) for op, *_ in self.code):
            raise PatternLimitError("loops around what may be empty need the search")
        self.back_code = Program(reversed_pattern(pattern), label).code
        self.f_index, self.f_states, self.f_next, self.f_accept, self.f_dead = {}, [], [], [], []
        self.b_index, self.b_states, self.b_next, self.b_accept, self.b_dead = {}, [], [], [], []
        self.f_start = self._f_state(tuple(self._closure(self.code, [0])), False)
        self.b_start = self._b_state(frozenset(self._closure(self.back_code, [0])))

    @staticmethod
    def _closure(code, pcs) -> list[int]:
        out, seen, todo = [], set(), list(reversed(pcs))
        while todo:
            pc = todo.pop()
            if pc in seen:
                continue
            seen.add(pc)
            op, a, b = code[pc]
            if op == SPLIT:
                todo += (b, a)
            elif op == JUMP:
                todo.append(a)
            else:
                out.append(pc)
        return out

    def _f_state(self, threads: tuple[int, ...], found: bool) -> int:
        """found: a match has been seen, so nothing starts anew."""
        key = threads, found
        if key not in self.f_index:
            if len(self.f_states) >= MAX_STATES:
                raise PatternLimitError("too many states")
            self.f_index[key] = len(self.f_states)
            self.f_states.append(key)
            self.f_next.append([-1] * self.width)
            self.f_accept.append(False)
            self.f_dead.append(not threads)
        return self.f_index[key]

    def f_step(self, state: int, symbol: int) -> int:
        threads, found = self.f_states[state]
        after = self._closure(self.code, [pc + 1 for pc in threads if self.code[pc][:2] == (ROW, symbol)])
        accept = False
        for k, pc in enumerate(after):
            if self.code[pc][0] == MATCH:
                after, accept, found = after[:k], True, True
                break
        if not found:
            after = list(dict.fromkeys([*after, *self._closure(self.code, [0])]))
        key = tuple(after), found
        # accepting states are told apart by a mark
        if accept:
            key = (*after, -1), True
            if key not in self.f_index:
                self.f_index[key] = self._plain(tuple(after))
        nxt = self.f_index[key] if accept else self._f_state(*key)
        self.f_next[state][symbol] = nxt
        return nxt

    def _plain(self, threads: tuple[int, ...]) -> int:
        self.f_states.append((threads, True))
        self.f_next.append([-1] * self.width)
        self.f_accept.append(True)
        self.f_dead.append(not threads)
        return len(self.f_states) - 1

    def _b_state(self, threads: frozenset) -> int:
        if threads not in self.b_index:
            self.b_index[threads] = len(self.b_states)
            self.b_states.append(threads)
            self.b_next.append([-1] * self.width)
            self.b_accept.append(any(self.back_code[pc][0] == MATCH for pc in threads))
            self.b_dead.append(not threads)
        return self.b_index[threads]

    def b_step(self, state: int, symbol: int) -> int:
        pcs = [pc + 1 for pc in self.b_states[state] if self.back_code[pc][:2] == (ROW, symbol)]
        nxt = self._b_state(frozenset(self._closure(self.back_code, pcs)))
        self.b_next[state][symbol] = nxt
        return nxt

    def overlapping(self, symbols: bytes) -> list[tuple[int, int]]:
        """(start, end) of the match at each start that has one. Searches that
        come to one state at one place go on alike, so each place is left once
        in a state, however long the matches are."""
        out, ahead = [], {}
        step, accept, dead = self.f_next, self.f_accept, self.f_dead
        start, n = self._f_state(tuple(self._closure(self.code, [0])), True), len(symbols)
        for at in range(n):
            state, pos, path = start, at, []
            while pos < n and not dead[state] and (pos, state) not in ahead:
                path.append((pos, state))
                nxt = step[state][symbols[pos]]
                state = nxt if nxt >= 0 else self.f_step(state, symbols[pos])
                pos += 1
            end = ahead.get((pos, state), -1)
            after = state
            for place in reversed(path):
                if end < 0 and accept[after]:
                    end = place[0] + 1
                ahead[place] = end
                after = place[1]
            if end >= 0:
                out.append((at, end))
        return out

    def matches(self, symbols: bytes) -> list[tuple[int, int]]:
        """(start, end) of all matches, each search after the last match."""
        out, at, n = [], 0, len(symbols)
        step, accept, dead, start = self.f_next, self.f_accept, self.f_dead, self.f_start
        while at < n:
            state, end, pos = start, -1, at
            for symbol in symbols[at:] if at == 0 else memoryview(symbols)[at:]:
                nxt = step[state][symbol]
                state = nxt if nxt >= 0 else self.f_step(state, symbol)
                pos += 1
                if accept[state]:
                    end = pos
                if dead[state]:
                    break
            if end < 0:
                break
            state, first = self.b_start, end
            for k in range(end - 1, at - 1, -1):
                nxt = self.b_next[state][symbols[k]]
                state = nxt if nxt >= 0 else self.b_step(state, symbols[k])
                if self.b_accept[state]:
                    first = k
                if self.b_dead[state]:
                    break
            out.append((first, end))
            at = end
        return out


#: The character of label 0, and the marks around a match.
BASE, BEGIN, CLOSE = 48, b"\x01", b"\x02"


def regex_of(p: Pattern, label: dict[str, int]) -> str:
    """A pattern over labels as a regular expression over their characters,
    with the same preferences among matches."""
    if isinstance(p, Var):
        return f"\\x{{{BASE + label[p.name]:x}}}"
    if isinstance(p, Seq):
        return "".join(regex_of(i, label) for i in p.items)
    if isinstance(p, Alt):
        return "(?:" + "|".join(regex_of(i, label) for i in p.items) + ")"
    if isinstance(p, Repeat):
        bounds = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((p.least, p.most), f"{{{p.least},{'' if p.most is None else p.most}}}")
        return f"(?:{regex_of(p.item, label)}){bounds}{'' if p.greedy else '?'}"
    return "(?:)"


def marked_matches(regex: str, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Starts and ends of all matches of a regular expression that matches no
    empty text, each search after the last match, in linear time by a native
    engine that puts marks around them; None if it can't."""
    if len(symbols) > MAX_TEXT:
        return None
    text = pa.array([(symbols + np.uint8(BASE)).tobytes()], pa.binary()).cast(pa.string())
    try:
        done = pc.replace_substring_regex(text, pattern=regex, replacement="\x01\\0\x02")
    except pa.ArrowInvalid:
        return None
    out = np.frombuffer(done[0].as_buffer(), np.uint8)
    a, b = np.flatnonzero(out == BEGIN[0]), np.flatnonzero(out == CLOSE[0])
    # before a mark stand the two of each match before it, and its match's first
    return a - 2 * np.arange(len(a)), b - 2 * np.arange(len(b)) - 1


def reversed_pattern(p: Pattern) -> Pattern:
    if isinstance(p, Seq):
        return Seq(tuple(reversed_pattern(i) for i in reversed(p.items)))
    if isinstance(p, Alt):
        return Alt(tuple(map(reversed_pattern, p.items)))
    if isinstance(p, Repeat):
        return Repeat(reversed_pattern(p.item), p.least, p.most, p.greedy)
    return p
