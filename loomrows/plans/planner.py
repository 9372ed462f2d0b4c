"""From a clause and a DataFrame to a Spark plan.

needed columns -> hash exchange on PARTITION BY -> sort within partitions ->
lag / lead and conditions of the row alone, packed into one mask, in Catalyst ->
the matching kernel over Arrow batches -> projection. Without lag and lead the
mask is made before the exchange, and columns of conditions alone don't cross it.

One exchange and one sort: the windows of lag and lead use the same keys and
order. Only columns that expressions or the output need reach the exchange.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.aggregates import NAMES
from ..functions.columns import Local, to_column
from ..operators.frame import Compiler, Scope, default_final, is_aggregate
from ..operators.kernel import Kernel, Plan
from ..operators.program import variables
from .ast import Call, Clause, Col, Exclude, Expr, Lit, Op, QueryError
from .types import shown, type_of

#: Conditions in one mask.
MAX_VARIABLES = 62
_SORT_FUNCTIONS = {"ABS", "CEIL", "CEILING", "FLOOR", "ROUND", "TRUNC", "TRUNCATE", "SQRT", "EXP", "LN", "LOG10", "SIGN", "POWER", "POW", "MOD", "GREATEST", "LEAST", "COALESCE", "UPPER", "LOWER", "LENGTH", "TRIM"}


class OrderExpressionError(QueryError):
    """An ORDER BY key that can't be evaluated."""


def conjuncts(e: Expr) -> list[Expr]:
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, Op) and e.name == "AND" else [e]


def fold(name: str, known: list[str]) -> str | None:
    return name if name in known else next((k for k in known if k.lower() == name.lower()), None)


class Planner:
    def __init__(self, clause: Clause, df: DataFrame, standard_semantics: bool = False):
        self.clause, self.df, self.standard = clause, df, standard_semantics
        self.columns = df.columns
        names = [c.lower() for c in self.columns]
        if len(set(self.columns)) != len(names):
            raise QueryError("the input has two columns of one name")
        self._variables()
        self.scope = Scope(self.columns, self.labels, self.sets)
        self.partition = [self._input(c, RuntimeError) for c in clause.partition_by]
        self._validate()

    def _input(self, name: str, error=QueryError) -> str:
        found = fold(name, self.columns)
        if found is None:
            raise error(f"no such column: {name}")
        return found

    def _variables(self) -> None:
        c = self.clause
        used = variables(c.pattern)
        if len(used) > MAX_VARIABLES:
            raise QueryError(f"a pattern of more than {MAX_VARIABLES} variables")
        self.names: list[str] = []
        self.labels: dict[str, int] = {}
        self.define: dict[int, Expr] = {}
        for v in used:
            defined = fold(v, list(c.define)) if v not in c.quoted else (v if v in c.define else None)
            shown_as = defined if defined is not None else v if v in c.quoted else v.upper()
            if shown_as not in self.names:
                self.names.append(shown_as)
            self.labels[v] = self.names.index(shown_as)
            if defined is not None:
                self.define[self.labels[v]] = c.define[defined]
        unused = [v for v in c.define if fold(v, self.names) is None]
        if unused:
            raise QueryError(f"defined but not in the pattern: {', '.join(unused)}")
        self.sets = {n: frozenset([k]) for k, n in enumerate(self.names)}
        for union, members in c.subsets.items():
            if fold(union, self.names):
                raise QueryError(f"{union} is a pattern variable and a union variable")
            of = [fold(m, self.names) for m in members]
            if None in of:
                raise QueryError(f"SUBSET {union} names an unknown variable")
            self.sets[union] = frozenset(self.names.index(m) for m in of)
        # every spelling of a variable in the pattern leads to its number
        self.numbers = {v: self.labels[v] for v in used}

    def _validate(self) -> None:
        c = self.clause
        if c.skip[1] and fold(c.skip[1], list(self.sets)) is None:
            raise QueryError(f"AFTER MATCH SKIP TO an unknown variable: {c.skip[1]}")
        from ..operators.program import has

        if c.rows == "ALL" and c.empty == "UNMATCHED" and has(c.pattern, Exclude):
            raise QueryError("WITH UNMATCHED ROWS can't be combined with exclusions")
        seen = set()
        for _, name in c.measures:
            if name.lower() in seen:
                raise QueryError(f"two measures are called {name}")
            seen.add(name.lower())
        kind = lambda n: (f := fold(n, self.columns)) and self.df.schema[f].dataType
        for e in [m for m, _ in c.measures] + list(self.define.values()):
            for x in e.walk():
                if isinstance(x, Op) and x.name == "LIKE" and not all(isinstance(type_of(a, kind), (T.StringType, T.NullType)) for a in x.args):
                    raise QueryError("LIKE takes text on both sides; CAST what isn't")
                if is_aggregate(x) and any(is_aggregate(y) for a in x.args for y in a.walk()):
                    raise QueryError(f"an aggregate inside {x.name}")
                if isinstance(x, Col) and x.var is not None:
                    self.scope.variable(x.var)

    # ordering

    def _sort_key(self, e: Expr, text: str) -> Column:
        for x in e.walk():
            if isinstance(x, Call) and x.name not in _SORT_FUNCTIONS or isinstance(x, Op) and x.name not in ("+", "-", "*", "/", "//", "%", "**", "NEG"):
                raise OrderExpressionError(f"ORDER BY {text}: only arithmetic and scalar functions")
            if isinstance(x, Col) and fold(x.name, self.columns) is None:
                raise OrderExpressionError(f"ORDER BY {text}: no such column {x.name}")
        key = to_column(e, Local(self.df.schema, lambda n: fold(n, self.columns), lambda v: True, None))
        if key is None:
            if isinstance(e, Col):
                return F.col(f"`{fold(e.name, self.columns)}`")
            raise OrderExpressionError(f"ORDER BY {text} can't be evaluated")
        return key

    # the plan

    def build(self, output: list[str]) -> DataFrame:
        """The columns ``output`` of the input, then all measures."""
        c = self.clause
        one = c.rows != "ALL"
        explicit = any(isinstance(x, Call) and x.semantics for e, _ in c.measures for x in e.walk())
        measures = []
        for e, name in c.measures:
            own = any(isinstance(x, Call) and x.semantics == "FINAL" for x in e.walk())
            measures.append((e, name, default_final(e, one, explicit, self.standard), own))
        used: list[str] = []

        def use(e: Expr) -> None:
            for x in e.walk():
                if isinstance(x, Col) and (name := fold(x.name, self.columns)) and name not in used:
                    used.append(name)
                if isinstance(x, Call) and x.name in ("LAG", "LEAD") and x.args and isinstance(x.args[0], Lit) and isinstance(x.args[0].value, str):
                    use(Col(x.args[0].value))
                if isinstance(x, Call) and x.over and x.name in NAMES:
                    for k, _ in x.over[0]:
                        use(k)

        for e, *_ in measures:
            use(e)
        keys = [F.col(f"`{p}`") for p in self.partition]
        order: list[Column] = []
        sorts = []
        for k in c.order_by:
            col = self._sort_key(k.expr, k.text)
            sorts.append((col, k))
        tie = F.col("__tie")
        df = self.df
        local = [f"`{n}`" for n in self.columns]
        # sort keys under names of their own, before the exchange
        df = df.select(*local, F.monotonically_increasing_id().alias("__tie"), *(s.alias(f"__k{i}") for i, (s, _) in enumerate(sorts)))
        for i, (_, k) in enumerate(sorts):
            col = F.col(f"__k{i}")
            order.append((col.asc_nulls_first() if k.nulls_first else col.asc_nulls_last()) if k.ascending else (col.desc_nulls_first() if k.nulls_first else col.desc_nulls_last()))
        order.append(tie.asc())
        window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
        bits, stateful, masked = [], {}, []
        cond_columns: set[str] = set()
        shifted = False
        for k in range(len(self.names)):
            e = self.define.get(k, Lit(True))
            near: Column | None = None
            rest: list[Expr] = []
            for part in conjuncts(e):
                resolve = lambda n: fold(n, self.columns)
                own = lambda v, k=k: self.scope.variable(v) == frozenset([k])
                col = to_column(part, Local(self.df.schema, resolve, own, window))
                if col is None:
                    rest.append(part)
                    use(part)
                else:
                    for x in part.walk():
                        if isinstance(x, Col) and (n := fold(x.name, self.columns)):
                            cond_columns.add(n)
                        shifted |= isinstance(x, Call) and x.name in ("PREV", "NEXT", "LAG", "LEAD")
                    near = col if near is None else near & col
            if rest:
                whole = rest[0]
                for part in rest[1:]:
                    whole = Op("AND", (whole, part))
                stateful[k] = whole
            bits.append(F.lit(1) if near is None else F.coalesce(near.cast("int"), F.lit(0)))
            masked.append(k)
        for e in stateful.values():  # fails here rather than on an executor
            Compiler(self.scope, True).value(e)
        for e, _, final, own in measures:
            Compiler(self.scope, False, final, own).value(e)
        mask = F.lit(0).cast("long")
        for place, b in enumerate(bits):
            mask = mask.bitwiseOR(F.shiftleft(b.cast("long"), place))
        needed = dict.fromkeys([*used, *output, *self.partition, *(cond_columns if shifted else ())])
        rows = df.select(*([] if shifted else [mask.alias("__mask")]), *(f"`{n}`" for n in needed), "__tie", *(f"__k{i}" for i in range(len(sorts))))
        if keys:
            rows = rows.repartition(*keys)
        else:
            warnings.warn("MATCH_RECOGNIZE without PARTITION BY runs in one task", stacklevel=2)
            rows = rows.repartition(1)
        rows = rows.sortWithinPartitions(*keys, *order)
        group = F.xxhash64(*(x for k in keys for x in (k.isNull(), k))) if keys else F.lit(0).cast("long")
        carried = dict.fromkeys([*used, *output])
        rows = rows.select(group.alias("__group"), (mask if shifted else F.col("__mask")).alias("__mask"), *(F.col(f"`{n}`").alias(f"c_{n}") for n in carried))
        schema = T.StructType([T.StructField(n, self.df.schema[n].dataType) for n in output])
        for e, name, *_ in measures:
            kind = type_of(e, lambda n: (f := fold(n, self.columns)) and self.df.schema[f].dataType)
            schema.add(f"m_{name}", shown(kind))
        plan = Plan(c, self.numbers, self.names, self.sets, used, list(output), masked, stateful, measures, to_arrow_schema(schema))

        def run(batches):
            yield from Kernel(plan).run(batches)

        return rows.mapInArrow(run, schema)

    def layout(self) -> list[tuple[str, str]]:
        """Columns of SELECT *: (kind, name), kind 'in' or 'measure'."""
        c = self.clause
        order = [n for k in c.order_by if isinstance(k.expr, Col) and (n := fold(k.expr.name, self.columns))]
        measures = [("measure", name) for _, name in c.measures]
        if c.rows == "ONE" and c.measures:
            return [("in", p) for p in self.partition] + measures
        head = [("in", n) for n in [*self.partition, *order]]
        rest = [("in", n) for n in self.columns if n not in self.partition and n not in order]
        return [*head, *measures, *rest]
