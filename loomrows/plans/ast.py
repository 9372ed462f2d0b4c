"""Syntax trees of queries, expressions and patterns."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A query that can't be read or doesn't make sense."""


class Expr:
    """Base of expressions; ``parts`` are the direct operands."""

    def parts(self) -> list[Expr]:
        return []

    def walk(self):
        yield self
        for p in self.parts():
            yield from p.walk()


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Col(Expr):
    name: str
    var: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    var: str | None = None


@dataclass(frozen=True)
class Op(Expr):
    """An operator: name such as + = AND NOT NEG ||, or IN, BETWEEN, ISNULL."""

    name: str
    args: tuple[Expr, ...]

    def parts(self):
        return list(self.args)


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    other: Expr | None

    def parts(self):
        return [x for w in self.whens for x in w] + ([self.other] if self.other else [])


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    kind: str
    params: tuple[int, ...] = ()

    def parts(self):
        return [self.arg]


@dataclass(frozen=True)
class Array(Expr):
    items: tuple[Expr, ...]

    def parts(self):
        return list(self.items)


@dataclass(frozen=True)
class Call(Expr):
    """A function; semantics is RUNNING, FINAL or None."""

    name: str
    args: tuple[Expr, ...] = ()
    semantics: str | None = None
    distinct: bool = False
    order: tuple[tuple[Expr, bool], ...] = ()
    where: Expr | None = None
    over: tuple | None = None

    def parts(self):
        return [*self.args, *(e for e, _ in self.order), *([self.where] if self.where else [])]


# patterns


class Pattern:
    pass


@dataclass(frozen=True)
class Var(Pattern):
    name: str


@dataclass(frozen=True)
class Empty(Pattern):
    pass


@dataclass(frozen=True)
class Anchor(Pattern):
    end: bool


@dataclass(frozen=True)
class Seq(Pattern):
    items: tuple[Pattern, ...]


@dataclass(frozen=True)
class Alt(Pattern):
    items: tuple[Pattern, ...]


@dataclass(frozen=True)
class Repeat(Pattern):
    item: Pattern
    least: int
    most: int | None
    greedy: bool


@dataclass(frozen=True)
class Exclude(Pattern):
    item: Pattern


@dataclass
class SortKey:
    expr: Expr
    text: str
    ascending: bool = True
    nulls_first: bool = False


@dataclass
class Clause:
    """One MATCH_RECOGNIZE clause, or the row pattern of a window."""

    pattern: Pattern
    partition_by: list[str] = field(default_factory=list)
    order_by: list[SortKey] = field(default_factory=list)
    measures: list[tuple[Expr, str]] = field(default_factory=list)
    rows: str = "ONE"  # ONE, ALL
    empty: str = "SHOW"  # SHOW, OMIT, UNMATCHED
    skip: tuple[str, str | None] = ("PAST", None)  # PAST, NEXT, FIRST v, LAST v
    subsets: dict[str, list[str]] = field(default_factory=dict)
    define: dict[str, Expr] = field(default_factory=dict)
    quoted: frozenset[str] = frozenset()


@dataclass
class Source:
    """A relation of FROM: a table or VALUES rows, with its clause."""

    table: str | None
    rows: list[list[object]] | None = None
    columns: list[str] | None = None
    clause: Clause | None = None
    alias: str | None = None


@dataclass
class Query:
    items: list[tuple[Expr, str | None]]
    sources: list[Source]
    order_by: list[SortKey] = field(default_factory=list)
    windows: dict[str, Clause] = field(default_factory=dict)
    where: Expr | None = None
    distinct: bool = False
    limit: int | None = None
