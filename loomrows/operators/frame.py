"""Evaluation of expressions against a match in the making or a found one.

``compile_define`` and ``compile_measure`` turn an expression into a function
(frame, row) -> value. In a measure row is None for an empty match."""

from __future__ import annotations

from ..functions import aggregates as agg
from ..functions.scalar import BINARY, FUNCTIONS, cast, is_null
from ..plans.ast import Array, Call, Case, Cast, Col, Expr, Lit, Op, QueryError, Star
from ..plans.parser import NAVIGATION


class Frame:
    """One partition's columns (lists), and the match that starts at ``start``:
    labels[k] is the label number of row start + k."""

    __slots__ = ("cols", "lo", "hi", "start", "labels", "number", "names", "totals", "lists")

    def __init__(self, cols: dict[str, list], lo: int, hi: int, names: list[str]):
        self.cols, self.lo, self.hi, self.names = cols, lo, hi, names
        self.start, self.labels, self.number = lo, [], 1
        self.totals: dict[object, list] = {}
        self.lists: dict = {}

    def begin(self, start: int, labels: list[int], number: int) -> None:
        self.start, self.labels, self.number = start, labels, number
        self.totals.clear()
        self.lists.clear()

    def cut(self, n: int) -> None:
        """The labels beyond the first n are taken back."""
        for t in self.totals.values():
            if len(t) > n + 1:
                del t[n + 1 :]

    @property
    def end(self) -> int:
        return self.start + len(self.labels)


class Scope:
    """How names resolve: columns, and variables to sets of label numbers."""

    def __init__(self, columns: list[str], labels: dict[str, int], sets: dict[str, frozenset[int]]):
        self.exact = set(columns)
        self.folded = {c.lower(): c for c in reversed(columns)}
        self.labels, self.sets = labels, sets
        self.vars = {v.lower(): v for v in reversed(list(sets))}

    def column(self, name: str) -> str | None:
        return name if name in self.exact else self.folded.get(name.lower())

    def variable(self, name: str) -> frozenset[int]:
        v = name if name in self.sets else self.vars.get(name.lower())
        if v is None:
            raise QueryError(f"Forbidden table prefix or unknown pattern variable: {name}")
        return self.sets[v]


def is_navigation(e: Expr) -> bool:
    return isinstance(e, Call) and e.name in NAVIGATION


def is_aggregate(e: Expr) -> bool:
    return isinstance(e, Call) and e.name in agg.NAMES


def qualifiers(e: Expr) -> list[str]:
    """Pattern variables that an argument names."""
    out = []
    for x in e.walk():
        if isinstance(x, (Col, Star)) and x.var:
            out.append(x.var)
        elif isinstance(x, Call) and x.name == "CLASSIFIER" and x.args:
            out.append(x.args[0].name)
    return out


class Compiler:
    """define: a condition on the row being added; else a measure, ``final``
    telling the semantics where an expression doesn't."""

    def __init__(self, scope: Scope, define: bool, final: bool = False, explicit: bool = False):
        self.scope, self.define, self.final, self.explicit = scope, define, final, explicit

    # ordinary expressions; row(e) evaluates at a row, value(e) in the frame

    def _build(self, e: Expr, leaf):
        sub = lambda x: self._build(x, leaf)
        if (f := leaf(e)) is not None:
            return f
        if isinstance(e, Lit):
            v = e.value
            return lambda fr, i: v
        if isinstance(e, Op):
            return self._operator(e, sub)
        if isinstance(e, Case):
            whens = [(sub(c), sub(v)) for c, v in e.whens]
            other = sub(e.other) if e.other else lambda fr, i: None

            def case(fr, i):
                for c, v in whens:
                    if c(fr, i) is True:
                        return v(fr, i)
                return other(fr, i)

            return case
        if isinstance(e, Cast):
            f, kind, params = sub(e.arg), e.kind, e.params
            return lambda fr, i: cast(f(fr, i), kind, params)
        if isinstance(e, Array):
            items = [sub(x) for x in e.items]
            return lambda fr, i: [f(fr, i) for f in items]
        if isinstance(e, Call):
            return self._function(e, sub)
        raise QueryError(f"unsupported expression {e!r}")

    def _operator(self, e: Op, sub):
        args = [sub(a) for a in e.args]
        if e.name in BINARY:
            f, (a, b) = BINARY[e.name], args
            return lambda fr, i: f(a(fr, i), b(fr, i))
        if e.name == "AND":
            a, b = args

            def both(fr, i):
                x = a(fr, i)
                if x is False:
                    return False
                y = b(fr, i)
                return False if y is False else None if is_null(x) or is_null(y) else bool(x and y)

            return both
        if e.name == "OR":
            a, b = args

            def either(fr, i):
                x = a(fr, i)
                if not is_null(x) and x:
                    return True
                y = b(fr, i)
                return True if not is_null(y) and y else None if is_null(x) or is_null(y) else False

            return either
        a = args[0]
        if e.name == "NOT":
            return lambda fr, i: None if is_null(x := a(fr, i)) else not x
        if e.name == "NEG":
            return lambda fr, i: None if is_null(x := a(fr, i)) else -x
        if e.name == "ISNULL":
            return lambda fr, i: is_null(a(fr, i))
        if e.name == "IN":
            items = args[1:]

            def among(fr, i):
                x, unknown = a(fr, i), False
                if not items:
                    return False
                if is_null(x):
                    return None
                for f in items:
                    y = f(fr, i)
                    if is_null(y):
                        unknown = True
                    elif x == y:
                        return True
                return None if unknown else False

            return among
        raise QueryError(f"unknown operator {e.name}")

    def _function(self, e: Call, sub):
        args = [sub(a) for a in e.args]
        if e.name == "COALESCE":

            def coalesce(fr, i):
                for f in args:
                    if not is_null(x := f(fr, i)):
                        return x
                return None

            return coalesce
        if e.name == "NULLIF":
            a, b = args
            return lambda fr, i: None if (x := a(fr, i)) == b(fr, i) else x
        if e.name == "IF":
            c, a = args[:2]
            b = args[2] if len(args) > 2 else lambda fr, i: None
            return lambda fr, i: a(fr, i) if c(fr, i) is True else b(fr, i)
        f = FUNCTIONS.get(e.name)
        if f is None:
            raise QueryError(f"unknown function {e.name}")

        def call(fr, i):
            values = []
            for a in args:
                if is_null(x := a(fr, i)):
                    return None
                values.append(x)
            try:
                return f(*values)
            except Exception:
                return None

        return call

    def row(self, e: Expr):
        """e at one row, as in an argument of an aggregate or of FIRST."""

        def leaf(x: Expr):
            if isinstance(x, Col):
                name = self.scope.column(x.name)
                if x.var is not None:
                    self.scope.variable(x.var)
                if name is None:
                    return lambda fr, i: None
                return lambda fr, i: fr.cols[name][i] if i is not None else None
            if isinstance(x, Call):
                if x.name == "CLASSIFIER":
                    return self._classifier_at(self.scope.variable(x.args[0].name) if x.args else None)
                if x.name == "MATCH_NUMBER":
                    return lambda fr, i: fr.number
                if is_navigation(x) or is_aggregate(x) and x.name not in ("LAG", "LEAD"):
                    raise QueryError(f"{x.name} can't stand inside an aggregate or navigation function")
            return None

        return self._build(e, leaf)

    @staticmethod
    def _classifier_at(only: frozenset[int] | None):
        def label(fr, i):
            if i is None or not 0 <= i - fr.start < len(fr.labels):
                return None
            k = fr.labels[i - fr.start]
            return fr.names[k] if only is None or k in only else None

        return label

    def value(self, e: Expr):
        """e in the frame: navigation, aggregates and columns of variables."""

        def leaf(x: Expr):
            if isinstance(x, Col):
                return self._column(x)
            if isinstance(x, Call):
                if x.name == "CLASSIFIER":
                    if not x.args:
                        return self._classifier_at(None)
                    return self._logical(Call("LAST", (x,), x.semantics or "RUNNING"))
                if x.name == "MATCH_NUMBER":
                    return lambda fr, i: fr.number
                if x.name == "ROW_NUMBER":
                    return (lambda fr, i: fr.number) if x.over else lambda fr, i: None if i is None else i - fr.start + 1
                if x.name in ("FIRST", "LAST"):
                    return self._logical(x)
                if x.name in ("PREV", "NEXT"):
                    return self._physical(x)
                if x.name in ("LAG", "LEAD") and self.define:
                    return self._lag(x)
                if is_aggregate(x):
                    return self._aggregate(x)
            return None

        return self._build(e, leaf)

    def _set(self, e: Expr) -> frozenset[int] | None:
        sets = {self.scope.variable(q) for q in qualifiers(e)}
        if len(sets) > 1:
            raise QueryError("all columns of an argument must belong to one pattern variable")
        return next(iter(sets), None)

    def _column(self, x: Col):
        name = self.scope.column(x.name)
        if x.var is None:
            return (lambda fr, i: fr.cols[name][i] if i is not None else None) if name else lambda fr, i: None
        own = self.scope.variable(x.var)
        if name is None:
            return lambda fr, i: None
        ahead = self.final and not self.define and not self.explicit

        def column(fr, i):
            if i is None:
                return None
            labels, start = fr.labels, fr.start
            if labels and 0 <= i - start < len(labels) and labels[i - start] in own:
                return fr.cols[name][i]
            for k in range(len(labels) - 1 if ahead else min(i - start, len(labels) - 1), -1, -1):
                if labels[k] in own:
                    return fr.cols[name][start + k]
            return None

        return column

    def _is_final(self, semantics: str | None) -> bool:
        if self.define:
            return False
        return semantics == "FINAL" if semantics else self.final

    def _constant(self, args: tuple, k: int, default):
        if len(args) <= k:
            return default
        if not isinstance(args[k], Lit) or not isinstance(args[k].value, int) or args[k].value < 0:
            raise QueryError("an offset must be a whole number that isn't negative")
        return args[k].value

    def _pick(self, x: Call):
        """The row that FIRST or LAST chooses."""
        if not 1 <= len(x.args) <= 2:
            raise QueryError(f"{x.name} takes one or two arguments")
        own, n, first = self._set(x.args[0]), self._constant(x.args, 1, 0), x.name == "FIRST"
        final = self._is_final(x.semantics)
        if x.name == "FIRST" and x.semantics is None and not self.define:
            final = True

        def pick(fr, i):
            labels = fr.labels
            stop = len(labels) if final or i is None else min(i - fr.start + 1, len(labels))
            if own is None:
                k = n if first else stop - 1 - n
                return fr.start + k if 0 <= k < stop else None
            left = n
            for k in range(stop) if first else range(stop - 1, -1, -1):
                if labels[k] in own:
                    if not left:
                        return fr.start + k
                    left -= 1
            return None

        return pick

    def _logical(self, x: Call):
        pick, at = self._pick(x), self.row(x.args[0])
        return lambda fr, i: None if (r := pick(fr, i)) is None else at(fr, r)

    def _physical(self, x: Call):
        if not 1 <= len(x.args) <= 2:
            raise QueryError(f"{x.name} takes one or two arguments")
        n = self._constant(x.args, 1, 1) * (-1 if x.name == "PREV" else 1)
        inner = x.args[0]
        if isinstance(inner, Call) and inner.name in ("FIRST", "LAST"):
            pick, at = self._pick(inner), self.row(inner.args[0])
        else:
            own, at = self._set(inner), self.row(inner)
            if own is None:
                pick = lambda fr, i: i
            else:
                last = next(Call("LAST", (c,)) for c in inner.walk() if isinstance(c, Col) and c.var or isinstance(c, Call) and c.name == "CLASSIFIER" and c.args)
                pick = self._pick(Call("LAST", last.args, "RUNNING"))
        if self.define and any(isinstance(c, Call) and c.name == "CLASSIFIER" for c in inner.walk()) and n > 0:
            return lambda fr, i: None

        def shifted(fr, i):
            r = pick(fr, i)
            if r is None or not fr.lo <= r + n < fr.hi:
                return None
            return at(fr, r + n)

        return shifted

    def _lag(self, x: Call):
        n = self._constant(x.args, 1, 1) * (-1 if x.name == "LAG" else 1)
        first = x.args[0]
        at = self.row(Col(first.value) if isinstance(first, Lit) and isinstance(first.value, str) else first)
        default = self.value(x.args[2]) if len(x.args) > 2 else lambda fr, i: None
        return lambda fr, i: at(fr, i + n) if fr.lo <= i + n < fr.hi else default(fr, i)

    def _aggregate(self, x: Call):
        if x.name == "COUNT" and (not x.args or isinstance(x.args[0], Star)):
            own = self.scope.variable(x.args[0].var) if x.args and x.args[0].var else None
            args = [lambda fr, i: 1]
        else:
            if not x.args:
                raise QueryError(f"{x.name} needs an argument")
            sets = {s for a in x.args if (s := self._set(a)) is not None}
            if len(sets) > 1:
                raise QueryError(f"all arguments of {x.name} must belong to one pattern variable")
            own = next(iter(sets), None)
            args = [self.row(a) for a in x.args]
        where = self.row(x.where) if x.where else None
        order = [(self.row(e), up) for e, up in x.order] + ([(self.row(e), up) for e, up in x.over[0]] if x.over else [])
        before = x.over[1] if x.over else None
        final = self._is_final(x.semantics) and not (x.over and x.over[0])
        name, distinct = x.name, x.distinct
        if name == "COUNT" and own is None and where is None and not order and before is None and not distinct and (not x.args or isinstance(x.args[0], Star)):
            return lambda fr, i: 0 if i is None else len(fr.labels) if final else min(i - fr.start + 1, len(fr.labels))
        if self.define and name in agg.INCREMENTAL and where is None and not order and not distinct and before is None:
            return self._running_total(name, args[0], own)
        key, told, nulls_out = object(), object(), name == "ARRAY_AGG"
        if not self.define and name in agg.INCREMENTAL and not order and before is None and not distinct:
            return self._kept_total(name, args[0], own, where, final)

        def rows_of(fr, stop):
            """Rows of the first stop labels, kept while a measure moves on."""
            done, rows = fr.lists.get(key, (0, []))
            if self.define or stop < done:
                done, rows = 0, []
            for k in range(done, stop):
                if (own is None or fr.labels[k] in own) and (where is None or where(fr, fr.start + k) is True):
                    rows.append(fr.start + k)
            fr.lists[key] = stop, rows
            return rows

        def run(fr, i):
            if final and i is not None and not self.define:  # one value for all rows of a match
                if told not in fr.lists:
                    fr.lists[told] = whole(fr, i)
                return fr.lists[told]
            return whole(fr, i)

        def whole(fr, i):
            if i is None:
                return 0 if name in ("COUNT", "COUNT_IF", "APPROX_DISTINCT", "COUNT_DISTINCT") else None
            stop = len(fr.labels) if final else min(i - fr.start + 1, len(fr.labels))
            rows = rows_of(fr, stop)
            if before is not None:
                rows = [r for r in rows if r >= fr.start + stop - 1 - before]
            if order:
                rows = list(rows)
                for f, up in reversed(order):
                    if nulls_out:
                        rows = [r for r in rows if not is_null(f(fr, r))]
                    rows.sort(key=lambda r, f=f: (is_null(v := f(fr, r)), 0 if is_null(v) else v), reverse=not up)
            columns = [[f(fr, r) for r in rows] for f in args]
            try:
                return agg.aggregate(name, columns, distinct)
            except (TypeError, ValueError, ZeroDivisionError, OverflowError):
                return None

        return run

    def _kept_total(self, name: str, arg, own, where, final: bool):
        """An aggregate of a measure, carried on from row to row of a match."""
        key = object()

        def add(total, x):
            n, s, low, high = total
            if name in ("SUM", "AVG"):
                x = float(x) if isinstance(x, str) else x
                return n + 1, x if n == 0 else s + x, None, None
            if name == "COUNT":
                return n + 1, None, None, None
            if n == 0:
                return 1, None, x, x
            try:
                return n + 1, None, min(low, x), max(high, x)
            except TypeError:
                return n + 1, None, min(str(low), str(x)), max(str(high), str(x))

        def run(fr, i):
            if i is None:
                return 0 if name == "COUNT" else None
            labels, stop = fr.labels, len(fr.labels) if final else min(i - fr.start + 1, len(fr.labels))
            done, total = fr.lists.get(key, (0, (0, None, None, None)))
            if stop < done:
                done, total = 0, (0, None, None, None)
            try:
                for k in range(done, stop):
                    if (own is None or labels[k] in own) and (where is None or where(fr, fr.start + k) is True):
                        x = arg(fr, fr.start + k)
                        if not is_null(x):
                            total = add(total, x)
            except (TypeError, ValueError, OverflowError):
                return None
            fr.lists[key] = stop, total
            n, s, low, high = total
            return n if name == "COUNT" else low if name == "MIN" else high if name == "MAX" else s if name == "SUM" or n == 0 else s / n

        return run

    def _running_total(self, name: str, arg, own):
        """An aggregate of a condition, as totals by number of labels."""
        me = object()

        def add(total, x):
            if x is None or x != x:
                return total
            n, s, low, high = total
            return (n + 1, x, x, x) if n == 0 else (n + 1, s + x if name in ("SUM", "AVG") else s, low if low <= x else x, high if high >= x else x)

        def run(fr, i):
            t = fr.totals.get(me)
            if t is None:
                t = fr.totals[me] = [(0, None, None, None)]
            labels, stop = fr.labels, i - fr.start + 1
            for k in range(len(t) - 1, stop - 1):
                t.append(add(t[k], arg(fr, fr.start + k)) if own is None or labels[k] in own else t[k])
            total = t[stop - 1]
            if own is None or labels[stop - 1] in own:
                total = add(total, arg(fr, i))
            n, s, low, high = total
            return n if name == "COUNT" else low if name == "MIN" else high if name == "MAX" else s if name == "SUM" or n == 0 else s / n

        return run


def default_final(e: Expr, one_row: bool, any_explicit: bool, standard: bool = False) -> bool:
    """Whether a measure without RUNNING or FINAL is final, by the form of its text."""
    if one_row:
        return True
    if standard:
        return False
    head = e.name if isinstance(e, Call) else ""
    if head in ("FIRST", "PREV", "NEXT"):
        return True
    if head == "LAST":
        return False
    inside = {x.name for x in e.walk() if isinstance(x, Call)}
    if inside & {"FIRST", "PREV", "NEXT"}:
        return True
    if "LAST" in inside:
        return False
    if any_explicit:
        return True
    return head not in ("COUNT", "ARRAY_AGG", "SUM", "MAX_BY", "MIN_BY", "STRING_AGG", "COUNT_IF", "SUM_IF", "AVG_IF")
