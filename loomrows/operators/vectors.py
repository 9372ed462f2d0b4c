"""Measures of ONE ROW PER MATCH computed for all matches at once, where rows
have one label at most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.ast import Call, Col, Lit, Star


def one_row_measures(kernel, table: pa.Table, symbol: np.ndarray, a: np.ndarray, b: np.ndarray, number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list | None:
    """A column per measure, or None if some measure needs the general way.
    a, b: first row and end of each match; lo, hi: its partition."""
    return Vectors(kernel, table, symbol, a, b, number, lo, hi).all()


class Vectors:
    def __init__(self, kernel, table, symbol, a, b, number, lo, hi):
        self.kernel, self.table, self.symbol, self.a, self.b, self.number, self.lo, self.hi = kernel, table, symbol, a, b, number, lo, hi
        self.cache: dict = {}

    def all(self) -> list | None:
        out = []
        for e, *_ in self.kernel.plan.measures:
            got = self.measure(e)
            if got is None:
                return None
            out.append(got)
        return out

    def inside(self, own) -> np.ndarray | None:
        """Whether each row has a label of own; None for any."""
        if own is None:
            return None
        if own not in self.cache:
            self.cache[own] = np.isin(self.symbol, list(own))
        return self.cache[own]

    def edge(self, own, first: bool) -> np.ndarray:
        """The first or last row of own in each match, -1 where there is none."""
        if own is None:
            return self.a if first else self.b - 1
        key = own, first
        if key not in self.cache:
            has, n = self.inside(own), len(self.symbol)
            if first:
                nxt = np.minimum.accumulate(np.where(has, np.arange(n), n)[::-1])[::-1]
                at = nxt[self.a]
                self.cache[key] = np.where(at < self.b, at, -1)
            else:
                prev = np.maximum.accumulate(np.where(has, np.arange(n), -1))
                at = prev[self.b - 1]
                self.cache[key] = np.where(at >= self.a, at, -1)
        return self.cache[key]

    def pick(self, name: str | None, rows: np.ndarray):
        if name is None:
            return pa.nulls(len(rows))
        column = self.table.column("c_" + name).combine_chunks()
        if pa.types.is_floating(column.type):
            column = pc.if_else(pc.is_nan(column), pa.scalar(None, column.type), column)
        return column.take(pa.array(rows, mask=rows < 0))

    def column(self, e):
        """(set of labels, column name) of a plain column."""
        if not isinstance(e, Col):
            return None
        scope = self.kernel.scope
        return (scope.variable(e.var) if e.var else None), scope.column(e.name)

    def measure(self, e):
        if isinstance(e, Lit) and isinstance(e.value, (int, float, str, bool)):
            return pa.array([e.value] * len(self.a))
        if isinstance(e, Col):
            own, name = self.column(e)
            return self.pick(name, self.edge(own, False))
        if not isinstance(e, Call) or e.distinct or e.order or e.where or e.over:
            return None
        name, args = e.name, e.args
        if name == "MATCH_NUMBER":
            return pa.array(self.number)
        if name == "CLASSIFIER" and not args:
            names = pa.array(self.kernel.plan.names)
            return names.take(pa.array(self.symbol[self.b - 1].astype(np.int64)))
        if name in ("FIRST", "LAST") and len(args) == 1 and (got := self.column(args[0])) and e.semantics != "RUNNING":
            return self.pick(got[1], self.edge(got[0], name == "FIRST"))
        if name in ("PREV", "NEXT") and (got := self.column(args[0])) and (len(args) == 1 or isinstance(args[1], Lit) and isinstance(args[1].value, int)):
            rows = self.edge(got[0], False)
            moved = rows + (args[1].value if len(args) > 1 else 1) * (-1 if name == "PREV" else 1)
            return self.pick(got[1], np.where((rows >= 0) & (moved >= self.lo) & (moved < self.hi), moved, -1))
        if name == "COUNT":
            if not args or isinstance(args[0], Star):
                own = self.kernel.scope.variable(args[0].var) if args and args[0].var else None
                return pa.array(self.b - self.a if own is None else self.total(self.inside(own).astype(np.int64)))
            if (got := self.column(args[0])) and got[1]:
                return pa.array(self.total(self.live(*got)[0].astype(np.int64)))
        if name in ("SUM", "AVG", "MIN", "MAX") and len(args) == 1 and (got := self.column(args[0])) and got[1]:
            column = self.table.column("c_" + got[1])
            if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
                return None
            return self.numbers(name, *got)
        return None

    def live(self, own, name):
        """Rows whose value counts, and the values with 0 elsewhere."""
        key = "live", own, name
        if key not in self.cache:
            column = self.table.column("c_" + name).combine_chunks()
            if pa.types.is_floating(column.type):
                column = pc.if_else(pc.is_nan(column), pa.scalar(None, column.type), column)
            ok = pc.is_valid(column).to_numpy(zero_copy_only=False)
            if own is not None:
                ok = ok & self.inside(own)
            values = None
            if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
                values = np.where(ok, pc.fill_null(column, 0).to_numpy(zero_copy_only=False), 0)
            self.cache[key] = ok, values
        return self.cache[key]

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sums over each match; each match by itself, so that nothing is lost to cancellation."""
        if not len(self.a):
            return np.empty(0, x.dtype)
        bounds = np.stack([self.a, self.b], 1).ravel()
        return np.add.reduceat(np.append(x, x.dtype.type(0)), bounds)[::2]

    def numbers(self, name: str, own, column: str):
        ok, values = self.live(own, column)
        n = self.total(ok.astype(np.int64))
        none = n == 0
        if not len(self.a):
            return pa.array([], pa.float64())
        if name in ("SUM", "AVG"):
            s = self.total(values)
            return pa.array(s if name == "SUM" else s / np.maximum(n, 1), mask=none)
        f, other = (np.minimum, np.inf) if name == "MIN" else (np.maximum, -np.inf)
        if np.issubdtype(values.dtype, np.integer):
            other = np.iinfo(values.dtype).max if name == "MIN" else np.iinfo(values.dtype).min
        x = np.append(np.where(ok, values, other), np.array(other, values.dtype))
        return pa.array(f.reduceat(x, np.stack([self.a, self.b], 1).ravel())[::2], mask=none)
