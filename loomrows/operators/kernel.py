"""The matching kernel: finds matches in sorted partitions that arrive as Arrow
batches, and emits source row numbers with measures.

Three ways to search, by what the conditions need:

* automaton: conditions are bits of a mask that the plan has computed, every
  row has one label at most, and the pattern has neither anchors nor exclusions
  and matches no empty row: one pass over all partitions of a chunk;
* memo: conditions are mask bits: ordered-choice search that never enters a
  failed state (instruction, row) again;
* stateful: some conditions depend on the match so far: the same search without
  the memo, with running totals that are taken back on backtracking, and a
  budget of steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.ast import Anchor, Clause, Exclude, Expr
from .frame import Compiler, Frame, Scope
from .program import CHECK, END, IN, JUMP, MARK, MATCH, OUT, ROW, SPLIT, START, Automaton, PatternLimitError, Program, has, marked_matches, nullable, regex_of

#: Steps of one stateful search, and failed states that are kept.
MAX_STEPS, MAX_FAILED = 20_000_000, 4_000_000


class PatternSearchLimitError(RuntimeError):
    """A search took more steps than its budget."""


@dataclass
class Plan:
    """What a task needs: sent to the executors once."""

    clause: Clause
    labels: dict[str, int]  # pattern variable: number
    names: list[str]  # shown label by number
    sets: dict[str, frozenset[int]]
    columns: list[str]  # of the input that expressions use
    output: list[str]  # input columns of the output
    masked: list[int]  # labels whose condition has a bit in the mask (bit = place here)
    stateful: dict[int, Expr]  # remaining condition by label
    measures: list[tuple[Expr, str, bool, bool]] = field(default_factory=list)  # expression, name, final, explicit
    schema: pa.Schema | None = None


class Searcher:
    """Finds the match that starts at a row, for one partition at a time."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.program = Program(plan.clause.pattern, plan.labels)
        scope = Scope(plan.columns, plan.labels, plan.sets)
        self.conditions: list = [None] * len(plan.labels)
        for k, e in plan.stateful.items():
            self.conditions[k] = Compiler(scope, define=True).value(e)
        self.bit = [0] * len(plan.labels)
        for place, k in enumerate(plan.masked):
            self.bit[k] = 1 << place
        self.memo = not plan.stateful

    def search(self, fr: Frame, mask: list[int], start: int, failed: set) -> tuple[list[int], list[bool]] | None:
        """(labels, excluded flags) of the preferred match at start."""
        code, bit, conditions, lo, hi, memo = self.program.code, self.bit, self.conditions, fr.lo, fr.hi, self.memo
        marks, many = self.program.marks, len(code)
        labels, flags = fr.labels, []
        labels.clear()
        fr.cut(0)
        pc_, pos, out, regs = 0, start, 0, (-1,) * marks
        todo: list = []
        steps = 0
        while True:
            op, a, b = code[pc_]
            ok = True
            if op == ROW:
                ok = pos < hi and (not bit[a] or mask[pos] & bit[a])
                if ok and conditions[a] is not None:
                    steps += 1
                    if steps > MAX_STEPS:
                        raise PatternSearchLimitError(f"the search from row {start - lo} of a partition took more than {MAX_STEPS} steps")
                    labels.append(a)
                    ok = conditions[a](fr, pos) is True
                    if not ok:
                        labels.pop()
                        fr.cut(len(labels))
                    else:
                        flags.append(bool(out))
                elif ok:
                    labels.append(a)
                    flags.append(bool(out))
                if ok:
                    pos += 1
                    pc_ += 1
            elif op == SPLIT:
                if memo:
                    key = (pos, pc_, regs) if marks else pos * many + pc_
                    ok = key not in failed
                    if ok:
                        failed.add(key)
                else:
                    steps += 1
                    if steps > MAX_STEPS:
                        raise PatternSearchLimitError(f"the search from row {start - lo} of a partition took more than {MAX_STEPS} steps")
                if ok:
                    todo.append((b, pos, len(labels), out, regs))
                    pc_ = a
            elif op == JUMP:
                pc_ = a
            elif op == MATCH:
                if memo:
                    failed.clear()
                return list(labels), flags
            elif op == START:
                ok = pos == lo
                pc_ += 1
            elif op == END:
                ok = pos == hi
                pc_ += 1
            elif op == OUT:
                out += 1
                pc_ += 1
            elif op == IN:
                out -= 1
                pc_ += 1
            elif op == MARK:
                regs = (*regs[:a], pos, *regs[a + 1 :])
                pc_ += 1
            elif op == CHECK:
                pc_ = b if regs[a] == pos else pc_ + 1
            if not ok:
                if not todo:
                    if len(failed) > MAX_FAILED:
                        failed.clear()
                    return None
                pc_, pos, n, out, regs = todo.pop()
                del labels[n:], flags[n:]
                fr.cut(n)


@dataclass
class Found:
    """Matches of a chunk: for each its number, first row, partition, labels and excluded flags."""

    number: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    labels: list[list[int]] = field(default_factory=list)
    flags: list[list[bool]] = field(default_factory=list)


class SkipError(ValueError):
    """AFTER MATCH SKIP leads nowhere."""


class Kernel:
    def __init__(self, plan: Plan):
        self.plan = plan
        c = plan.clause
        self.searcher = Searcher(plan)
        self.scope = Scope(plan.columns, plan.labels, plan.sets)
        self.measures = [(Compiler(self.scope, False, final, explicit).value(e), name) for e, name, final, explicit in plan.measures]
        self.automaton = None
        if not plan.stateful and c.skip[0] in ("PAST", "NEXT") and not has(c.pattern, Anchor) and not has(c.pattern, Exclude) and not nullable(c.pattern) and len(plan.labels) < 60 and set(plan.masked) == set(plan.labels.values()):
            try:
                self.automaton = Automaton(c.pattern, plan.labels)
                self.regex = regex_of(c.pattern, plan.labels)
            except PatternLimitError:
                self.automaton = None
        self.skip_set = self.scope.variable(c.skip[1]) if c.skip[1] else None

    # chunks of whole partitions

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(0))
            new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if last is not None and keys[0] != last:
                yield from self._chunk(held)
                held = []
            last = keys[-1]
            if len(new):
                cut = int(new[-1])
                yield from self._chunk([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from self._chunk(held)

    def _chunk(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        if not table.num_rows:
            return
        keys = table.column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        ends = np.append(starts[1:], len(keys))
        mask = table.column(1).to_numpy()
        quick = self._quick(table, mask, starts, ends) if self.automaton else None
        out = quick if quick is not None else self._slow(table, mask, starts, ends)
        for start in range(0, out.num_rows, 65_536):
            yield out.slice(start, 65_536)

    def _lists(self, table: pa.Table) -> dict[str, list]:
        out = {}
        for name in self.plan.columns:
            values = table.column("c_" + name)
            if pa.types.is_floating(values.type):
                values = pc.if_else(pc.is_nan(values), pa.scalar(None, values.type), values)
            out[name] = values.to_pylist()
        return out

    def _slow(self, table: pa.Table, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        cols, masks, skip = self._lists(table), mask.tolist(), self.plan.clause.skip[0]
        found, frames = Found(), []
        for g, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            fr = Frame(cols, lo, hi, self.plan.names)
            frames.append(fr)
            at, number, failed = lo, 1, set()
            while at < hi:
                fr.begin(at, [], number)
                got = self.searcher.search(fr, masks, at, failed)
                if got is None:
                    at += 1
                    continue
                labels, flags = got
                found.number.append(number)
                found.start.append(at)
                found.group.append(g)
                found.labels.append(labels)
                found.flags.append(flags)
                number += 1
                at = self._next(at, labels, skip)
        return self._emit(table, found, frames, starts, ends)

    def _next(self, at: int, labels: list[int], skip: str) -> int:
        if not labels or skip == "NEXT":
            return at + 1
        if skip == "PAST":
            return at + len(labels)
        places = [k for k, v in enumerate(labels) if v in self.skip_set]
        if not places:
            raise SkipError("AFTER MATCH SKIP failed: pattern variable is not present in match")
        k = places[0] if skip == "FIRST" else places[-1]
        if k == 0:
            raise SkipError("AFTER MATCH SKIP failed: cannot skip to first row of match")
        return at + k

    def _emit(self, table: pa.Table, found: Found, frames: list[Frame], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        c, measures = self.plan.clause, [f for f, _ in self.measures]
        if c.rows == "SEEK":
            return self._sought(table, found, frames, starts, ends)
        rows: list[int] = []
        values: list[list] = [[] for _ in measures]
        pending: list[tuple[int, int, list]] = []  # of unmatched rows
        unmatched = c.rows == "ALL" and c.empty == "UNMATCHED"
        if unmatched:
            seen = np.zeros(table.num_rows, bool)
            for s, labels in zip(found.start, found.labels, strict=True):
                seen[s : s + max(1, len(labels))] = True
            pending = np.flatnonzero(~seen).tolist()
        at = 0
        for number, s, g, labels, flags in zip(found.number, found.start, found.group, found.labels, found.flags, strict=True):
            while unmatched and at < len(pending) and pending[at] < s:
                rows.append(pending[at])
                for v in values:
                    v.append(None)
                at += 1
            fr = frames[g]
            fr.begin(s, labels, number)
            if not labels:
                if c.rows == "ONE" or c.empty != "OMIT":
                    rows.append(s)
                    for f, v in zip(measures, values, strict=True):
                        v.append(f(fr, None))
                continue
            if c.rows == "ONE":
                last = s + len(labels) - 1
                rows.append(last)
                for f, v in zip(measures, values, strict=True):
                    v.append(f(fr, last))
                continue
            for k, flag in enumerate(flags):
                if not flag:
                    rows.append(s + k)
                    for f, v in zip(measures, values, strict=True):
                        v.append(f(fr, s + k))
        for r in pending[at:] if unmatched else ():
            rows.append(r)
            for v in values:
                v.append(None)
        return self._batch(table, np.array(rows, dtype=np.int64), values)

    def _sought(self, table: pa.Table, found: Found, frames: list[Frame], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        """Every row with the measures of the first match that starts there or after it."""
        n = table.num_rows
        values: list[list] = [[] for _ in self.measures]
        at = np.full(n, n, np.int64)
        for number, s, g, labels in zip(found.number, found.start, found.group, found.labels, strict=True):
            if not labels:
                continue
            fr = frames[g]
            fr.begin(s, labels, number)
            at[s] = len(values[0]) if values else 0
            for (f, _), v in zip(self.measures, values, strict=True):
                v.append(f(fr, s + len(labels) - 1))
        # matches come in the order of their rows, so the next one has the least number
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            at[lo:hi] = np.minimum.accumulate(at[lo:hi][::-1])[::-1]
        which = pa.array(at, mask=at == n)
        kinds = list(self.plan.schema)[len(self.plan.output) :]
        return self._batch(table, np.arange(n), [_array(v, f.type).take(which) for v, f in zip(values, kinds, strict=True)])

    def _batch(self, table: pa.Table, rows: np.ndarray, values: list) -> pa.RecordBatch:
        n = len(self.plan.output)
        taken = [table.column("c_" + name if "c_" + name in table.column_names else "o_" + name).take(pa.array(rows)) for name in self.plan.output]
        made = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else _array(v, f.type) for v, f in zip(values, list(self.plan.schema)[n:], strict=True)]
        columns = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(f.type) for x, f in zip([*taken, *made], self.plan.schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=self.plan.schema)

    # rows with one label at most

    def _quick(self, table: pa.Table, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        if (mask & (mask - 1)).any():
            return None
        k = len(self.plan.masked)
        symbol = np.full(len(mask), len(self.plan.labels), np.uint8)
        for place in range(k):
            symbol[mask == (1 << place)] = self.plan.masked[place]
        # partitions lie one after another with a separator between
        joined = np.insert(symbol, starts[1:], len(self.plan.labels) + 1)
        try:
            spans = marked_matches(self.regex, joined) if self.plan.clause.skip[0] == "PAST" else None
            if spans is None:
                found = self.automaton.matches if self.plan.clause.skip[0] == "PAST" else self.automaton.overlapping
                spans = np.array(found(joined.tobytes()), np.int64).reshape(-1, 2).T
        except PatternLimitError:
            return None
        a, b = spans
        shifted = starts + np.arange(len(starts))
        group = np.searchsorted(shifted, a, side="right") - 1
        a, b = a - group, b - group
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.empty(0, bool)
        at = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0)) if len(group) else np.empty(0, int)
        number = np.arange(len(group)) - at + 1
        if self.plan.clause.rows == "ONE":
            from .vectors import one_row_measures

            values = one_row_measures(self, table, symbol, a, b, number, starts[group] if len(group) else group, ends[group] if len(group) else group)
            if values is not None:
                return self._batch(table, b - 1, values)
        found = Found(number.tolist(), a.tolist(), group.tolist(), [symbol[x:y].tolist() for x, y in zip(a, b, strict=True)], [[False] * (y - x) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        cols = self._lists(table) if self.measures else {}
        frames = [Frame(cols, lo, hi, self.plan.names) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
        return self._emit(table, found, frames, starts, ends)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        if pa.types.is_integer(kind):
            return pa.array([None if v is None else int(v) for v in values], kind)
        if pa.types.is_floating(kind):
            return pa.array([None if v is None else float(v) for v in values], kind)
        if pa.types.is_string(kind):
            return pa.array([None if v is None else str(v) for v in values], kind)
        raise
