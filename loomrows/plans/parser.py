"""A recursive-descent parser for row pattern queries."""

from __future__ import annotations

import itertools
import re

from .ast import Alt, Anchor, Array, Call, Case, Cast, Clause, Col, Empty, Exclude, Expr, Lit, Op, Pattern, Query, QueryError, Repeat, Seq, SortKey, Source, Star, Var

#: Longest text and deepest nesting of an expression.
MAX_CHARS, MAX_DEPTH = 10_000, 50
#: Variables of a PERMUTE, and branches it may unfold to.
MAX_PERMUTE, MAX_BRANCHES = 8, 50_000

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<sign>\{-|-\}|<>|!=|<=|>=|\|\||\*\*|//|=>|<<|>>|[-+*/%=<>(),.;{}?|^$&!\[\]])""",
    re.X | re.S,
)

_BITS = (("|",), ("^",), ("&",), ("<<", ">>"))
NAVIGATION = {"FIRST", "LAST", "PREV", "NEXT"}
_NOT_ALIAS = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "WINDOW", "MATCH_RECOGNIZE", "ON", "JOIN", "UNION", "INTERSECT", "EXCEPT", "AS"}


class Token:
    __slots__ = ("kind", "text", "start", "end")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end = kind, text, start, end


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise QueryError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m.group(), m.start(), m.end()))
        at = m.end()
    out.append(Token("end", "", len(sql), len(sql)))
    return out


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at, self.depth = sql, tokenize(sql), 0, 0
        self.quoted: set[str] = set()

    # tokens

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def is_word(self, *words: str, k: int = 0) -> bool:
        """Whether the words stand here, one after another."""
        return all((t := self.ahead(k + i)).kind == "name" and t.text.upper() == w for i, w in enumerate(words))

    def is_sign(self, sign: str, k: int = 0) -> bool:
        t = self.ahead(k)
        return t.kind == "sign" and t.text == sign

    def accept(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def accept_sign(self, sign: str) -> bool:
        if self.is_sign(sign):
            self.at += 1
            return True
        return False

    def fail(self, wanted: str):
        t = self.token
        raise QueryError(f"expected {wanted} at {t.start}, found {t.text or 'the end'!r}")

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            self.fail(" ".join(words))

    def expect_sign(self, sign: str) -> None:
        if not self.accept_sign(sign):
            self.fail(sign)

    def name(self, what: str = "a name") -> str:
        t = self.token
        if t.kind == "name":
            self.at += 1
            return t.text
        if t.kind == "quoted":
            self.at += 1
            text = t.text[1:-1].replace('""', '"')
            self.quoted.add(text)
            return text
        self.fail(what)
        raise AssertionError

    # queries

    def query(self) -> Query:
        self.expect("SELECT")
        distinct = self.accept("DISTINCT")
        items = [self._item()]
        while self.accept_sign(","):
            items.append(self._item())
        self.expect("FROM")
        sources = [self._source()]
        while self.accept_sign(","):
            sources.append(self._source())
        windows = {}
        if self.accept("WINDOW"):
            while True:
                own = self.name("a window name")
                self.expect("AS")
                self.expect_sign("(")
                windows[own] = self.clause(window=True)
                self.expect_sign(")")
                if not self.accept_sign(","):
                    break
        where = self.expr() if self.accept("WHERE") else None
        order = self._sort_keys() if self.accept("ORDER", "BY") else []
        limit = None
        if self.accept("LIMIT") and (limit := self._number()) is None:
            self.fail("a number of rows")
        self.accept_sign(";")
        if self.token.kind != "end":
            raise QueryError(f"unsupported after the row pattern clause: {self.sql[self.token.start :][:40]!r}; compose it with DataFrame operations instead")
        return Query(items, sources, order, windows, where, distinct, limit)

    def _item(self) -> tuple[Expr, str | None]:
        if self.accept_sign("*"):
            return Star(), None
        e = self.expr()
        if isinstance(e, Col) and e.var is None and self.is_sign(".") and self.is_sign("*", 1):
            self.at += 2
            return Star(e.name), None
        if self.accept("OVER"):
            e = Call("OVER", (e,), over=(self.name("a window name"),))
        alias = None
        if self.accept("AS") or self.token.kind == "quoted" or self.token.kind == "name" and self.token.text.upper() not in _NOT_ALIAS:
            alias = self.name("an alias")
        return e, alias

    def _source(self) -> Source:
        if self.accept_sign("("):
            self.expect("VALUES")
            rows = [self._row()]
            while self.accept_sign(","):
                rows.append(self._row())
            self.expect_sign(")")
            self.accept("AS")
            self.name("an alias of VALUES")
            if not self.accept_sign("("):
                raise QueryError("VALUES needs a list of column names")
            columns = [self.name()]
            while self.accept_sign(","):
                columns.append(self.name())
            self.expect_sign(")")
            if any(len(r) != len(columns) for r in rows):
                raise QueryError("VALUES rows and column names differ in number")
            source = Source(None, rows, columns)
        else:
            table = self.name("a table")
            while self.accept_sign("."):
                table += "." + self.name()
            source = Source(table)
            if self.token.kind == "name" and self.token.text.upper() not in _NOT_ALIAS:
                self.at += 1
        if self.accept("MATCH_RECOGNIZE"):
            self.expect_sign("(")
            source.clause = self.clause()
            self.expect_sign(")")
            if self.accept("AS") or self.token.kind == "quoted" or self.token.kind == "name" and self.token.text.upper() not in _NOT_ALIAS:
                source.alias = self.name("an alias")
        return source

    def _row(self) -> list[object]:
        many = self.accept_sign("(")
        values = [self._constant()]
        while many and self.accept_sign(","):
            values.append(self._constant())
        if many:
            self.expect_sign(")")
        return values

    def _constant(self) -> object:
        e = self.expr()
        if isinstance(e, Op) and e.name == "NEG" and isinstance(e.args[0], Lit):
            return -e.args[0].value
        if not isinstance(e, Lit):
            raise QueryError("VALUES takes literals only")
        return e.value

    def _sort_keys(self) -> list[SortKey]:
        keys = []
        while True:
            start = self.token.start
            e = self.expr()
            text = self.sql[start : self.tokens[self.at - 1].end]
            if len(text) > 1000:
                raise QueryError("an ORDER BY expression is longer than 1000 characters")
            up = not self.accept("DESC")
            if up:
                self.accept("ASC")
            first = False
            if self.accept("NULLS"):
                first = self.accept("FIRST")
                if not first:
                    self.expect("LAST")
            keys.append(SortKey(e, text, up, first))
            if not self.accept_sign(","):
                return keys

    # clauses

    def clause(self, window: bool = False) -> Clause:
        c = Clause(Empty())
        if self.accept("PARTITION", "BY"):
            c.partition_by.append(self.name("a column"))
            while self.accept_sign(","):
                c.partition_by.append(self.name("a column"))
        if self.accept("ORDER", "BY"):
            c.order_by = self._sort_keys()
        if self.accept("MEASURES"):
            while True:
                e = self.expr()
                self.accept("AS")
                c.measures.append((e, self.name("a measure's name")))
                if not self.accept_sign(","):
                    break
        if self.accept("ONE", "ROW", "PER", "MATCH"):
            pass
        elif self.accept("ALL", "ROWS", "PER", "MATCH"):
            c.rows = "ALL"
            if self.accept("OMIT", "EMPTY", "MATCHES"):
                c.empty = "OMIT"
            elif self.accept("WITH", "UNMATCHED", "ROWS"):
                c.empty = "UNMATCHED"
            else:
                self.accept("SHOW", "EMPTY", "MATCHES")
        if window and self.accept("ROWS", "BETWEEN"):
            self.expect("CURRENT", "ROW")
            self.expect("AND")
            self.expect("UNBOUNDED", "FOLLOWING")
        if self.accept("AFTER", "MATCH"):
            self.expect("SKIP")
            c.skip = self._skip()
        if self.is_word("INITIAL") or self.is_word("SEEK"):
            word = self.name().upper()
            if not window:
                raise QueryError(f"{word} belongs in a WINDOW")
            if word == "INITIAL":
                raise QueryError("a row pattern window requires SEEK")
        elif window:
            raise QueryError("a row pattern window requires SEEK")
        if not self.accept("PATTERN"):
            raise QueryError("MATCH_RECOGNIZE requires a PATTERN")
        self.expect_sign("(")
        c.pattern = Empty() if self.is_sign(")") else self._alternatives()
        self.expect_sign(")")
        if self.accept("SUBSET"):
            while True:
                union = self.name("a union variable")
                self.expect_sign("=")
                self.expect_sign("(")
                members = [self.name()]
                while self.accept_sign(","):
                    members.append(self.name())
                self.expect_sign(")")
                c.subsets[union] = members
                if not self.accept_sign(","):
                    break
        if self.accept("DEFINE"):
            while True:
                v = self.name("a pattern variable")
                self.expect("AS")
                if v in c.define:
                    raise QueryError(f"variable {v} is defined twice")
                start = self.token.start
                c.define[v] = self.expr()
                if self.tokens[self.at - 1].end - start > MAX_CHARS:
                    raise QueryError(f"the condition of {v} is longer than {MAX_CHARS} characters")
                if not self.accept_sign(","):
                    break
        c.quoted = frozenset(self.quoted)
        return c

    def _skip(self) -> tuple[str, str | None]:
        if self.accept("PAST", "LAST", "ROW"):
            return "PAST", None
        self.expect("TO")
        if self.accept("NEXT", "ROW"):
            return "NEXT", None
        for word in ("FIRST", "LAST"):
            if self.is_word(word) and self.ahead().kind in ("name", "quoted") and not (self.is_word("PATTERN", k=1) and self.is_sign("(", 2)):
                self.at += 1
                return word, self.name()
        return "LAST", self.name("a pattern variable")

    # patterns

    def _alternatives(self) -> Pattern:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError("the pattern is nested too deeply")
        items = [self._sequence()]
        while self.accept_sign("|"):
            items.append(self._sequence())
        self.depth -= 1
        return items[0] if len(items) == 1 else Alt(tuple(items))

    def _sequence(self) -> Pattern:
        items: list[Pattern] = []
        while not any(self.is_sign(s) for s in (")", "|", "-}", ",")):
            if self.token.kind == "end":
                self.fail(")")
            items.append(self._quantified())
        return Empty() if not items else items[0] if len(items) == 1 else Seq(tuple(items))

    def _quantified(self) -> Pattern:
        p = self._primary()
        while True:
            bounds = self._bounds()
            if bounds is None:
                return p
            p = Repeat(p, *bounds, greedy=not self.accept_sign("?"))
            if self.is_sign("*") or self.is_sign("+") or self.is_sign("?") or self.is_sign("{"):
                raise QueryError("a quantifier can't follow a quantifier")

    def _bounds(self) -> tuple[int, int | None] | None:
        for sign, bounds in (("*", (0, None)), ("+", (1, None)), ("?", (0, 1))):
            if self.accept_sign(sign):
                return bounds
        if not self.accept_sign("{"):
            return None
        least = self._number()
        if self.accept_sign(","):
            most = self._number()
            if most is not None and (least or 0) > most:
                raise QueryError("a quantifier's least number exceeds its largest")
            if most == 0:
                raise QueryError("a quantifier's largest number must be positive")
        elif least is None:
            raise QueryError("an empty quantifier")
        else:
            most = least
        self.expect_sign("}")
        return least or 0, most

    def _number(self) -> int | None:
        if self.token.kind == "number" and self.token.text.isdigit():
            self.at += 1
            return int(self.ahead(-1).text)
        return None

    def _primary(self) -> Pattern:
        if self.accept_sign("^"):
            return Anchor(False)
        if self.accept_sign("$"):
            return Anchor(True)
        if self.accept_sign("{-"):
            p = self._alternatives()
            self.expect_sign("-}")
            return Exclude(p)
        if self.accept_sign("("):
            p = Empty() if self.is_sign(")") else self._alternatives()
            self.expect_sign(")")
            return p
        if self.is_word("PERMUTE") and self.is_sign("(", 1):
            self.at += 2
            items = [self._alternatives()]
            while self.accept_sign(","):
                items.append(self._alternatives())
            self.expect_sign(")")
            return permuted(items)
        return Var(self.name("a pattern variable"))

    # expressions, by rising precedence

    def expr(self) -> Expr:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError("the expression is nested too deeply")
        e = self._and()
        while self.accept("OR"):
            e = Op("OR", (e, self._and()))
        self.depth -= 1
        return e

    def _and(self) -> Expr:
        e = self._not()
        while self.accept("AND"):
            e = Op("AND", (e, self._not()))
        return e

    def _not(self) -> Expr:
        if self.accept("NOT"):
            return Op("NOT", (self._not(),))
        return self._predicate()

    def _predicate(self) -> Expr:
        e = self._sum()
        while True:
            for sign in ("=", "<>", "!=", "<=", ">=", "<", ">"):
                if self.accept_sign(sign):
                    e = Op("<>" if sign == "!=" else sign, (e, self._sum()))
                    break
            else:
                if self.accept("IS"):
                    no = self.accept("NOT")
                    self.expect("NULL")
                    e = Op("ISNULL", (e,))
                    e = Op("NOT", (e,)) if no else e
                    continue
                at = self.at
                no = self.accept("NOT")
                if self.accept("BETWEEN"):
                    low = self._sum()
                    self.expect("AND")
                    e = Op("AND", (Op(">=", (e, low)), Op("<=", (e, self._sum()))))
                elif self.accept("IN"):
                    self.expect_sign("(")
                    e = Op("IN", (e, *self._list()))
                elif self.accept("LIKE"):
                    e = Op("LIKE", (e, self._sum()))
                else:
                    self.at = at
                    return e
                e = Op("NOT", (e,)) if no else e

    def _list(self) -> list[Expr]:
        if self.accept_sign(")"):
            return []
        if self.accept("SELECT"):
            items = [self.expr()]
            if self.is_word("FROM"):
                raise QueryError("subqueries with FROM aren't supported in row pattern expressions")
        else:
            items = [self.expr()]
            while self.accept_sign(","):
                items.append(self.expr())
        self.expect_sign(")")
        return items

    def _sum(self, level: int = 0) -> Expr:
        """Sums, and above them the operators on bits by their precedence."""
        if level == len(_BITS):
            return self._added()
        e = self._sum(level + 1)
        while sign := next((x for x in _BITS[level] if self.accept_sign(x)), None):
            e = Op(sign, (e, self._sum(level + 1)))
        return e

    def _added(self) -> Expr:
        e = self._product()
        while True:
            for sign in ("+", "-", "||"):
                if self.accept_sign(sign):
                    e = Op(sign, (e, self._product()))
                    break
            else:
                return e

    def _product(self) -> Expr:
        e = self._unary()
        while True:
            for sign in ("*", "//", "/", "%"):
                if self.is_sign(sign) and not (sign == "*" and self.is_word("FROM", k=1)):
                    self.at += 1
                    e = Op(sign, (e, self._unary()))
                    break
            else:
                return e

    def _unary(self) -> Expr:
        if self.accept_sign("-"):
            e = self._unary()
            return Lit(-e.value) if isinstance(e, Lit) and isinstance(e.value, (int, float)) else Op("NEG", (e,))
        if self.accept_sign("+"):
            return self._unary()
        e = self._operand()
        if self.accept_sign("**"):
            return Op("**", (e, self._unary()))
        return e

    def _operand(self) -> Expr:
        t = self.token
        if t.kind == "number":
            self.at += 1
            return Lit(int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "string":
            self.at += 1
            return Lit(t.text[1:-1].replace("''", "'"))
        if self.accept_sign("("):
            if self.accept("SELECT"):
                e = self.expr()
                if self.is_word("FROM"):
                    raise QueryError("subqueries with FROM aren't supported in row pattern expressions")
            else:
                e = self.expr()
            self.expect_sign(")")
            return e
        if t.kind == "name":
            word = t.text.upper()
            if word in ("RUNNING", "FINAL") and self.ahead().kind == "name":
                self.at += 1
                e = self._operand()
                return with_semantics(e, word)
            if word in ("TRUE", "FALSE", "NULL"):
                self.at += 1
                return Lit({"TRUE": True, "FALSE": False, "NULL": None}[word])
            if word == "CASE":
                return self._case()
            if word in ("CAST", "TRY_CAST") and self.is_sign("(", 1):
                self.at += 2
                e = self.expr()
                self.expect("AS")
                kind, params = self.name("a type").upper(), []
                if kind == "DOUBLE":
                    self.accept("PRECISION")
                if self.accept_sign("("):
                    params.append(self._number())
                    while self.accept_sign(","):
                        params.append(self._number())
                    self.expect_sign(")")
                self.expect_sign(")")
                return Cast(e, kind, tuple(params))
            if word == "ARRAY" and self.is_sign("[", 1):
                self.at += 2
                items = []
                while not self.accept_sign("]"):
                    items.append(self.expr())
                    if not self.is_sign("]"):
                        self.expect_sign(",")
                return Array(tuple(items))
            if word == "EXISTS" and self.is_sign("(", 1):
                self.at += 2
                self.expect("SELECT")
                self.expr()
                if self.is_word("FROM"):
                    raise QueryError("subqueries with FROM aren't supported in row pattern expressions")
                self.expect_sign(")")
                return Lit(True)
            if word == "EXTRACT" and self.is_sign("(", 1):
                self.at += 2
                part = self.name("a part of a date").upper()
                if part not in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
                    raise QueryError(f"EXTRACT doesn't know {part}")
                self.expect("FROM")
                e = self.expr()
                self.expect_sign(")")
                return Call(part, (e,))
            if self.is_sign("(", 1):
                return self._call()
            if word in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"):
                self.at += 1
                return Call(word)
        name = self.name("an expression")
        if self.is_sign(".") and not self.is_sign("*", 1):
            self.at += 1
            return Col(self.name("a column"), name)
        return Col(name)

    def _case(self) -> Expr:
        self.expect("CASE")
        operand = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.accept("WHEN"):
            cond = self.expr()
            self.expect("THEN")
            whens.append((Op("=", (operand, cond)) if operand is not None else cond, self.expr()))
        other = self.expr() if self.accept("ELSE") else None
        self.expect("END")
        return Case(tuple(whens), other)

    def _call(self) -> Expr:
        name = self.name().upper()
        self.expect_sign("(")
        distinct = self.accept("DISTINCT")
        args: list[Expr] = []
        order: tuple = ()
        if not self.is_sign(")"):
            if self.is_word("ORDER", "BY"):
                raise QueryError(f"{name}: ORDER BY needs an argument before it")
            while True:
                if self.accept_sign("*"):
                    args.append(Star())
                elif self.token.kind in ("name", "quoted") and self.is_sign(".", 1) and self.is_sign("*", 2):
                    v = self.name()
                    self.at += 2
                    args.append(Star(v))
                else:
                    args.append(self.expr())
                if not self.accept_sign(","):
                    break
            if self.accept("ORDER", "BY"):
                order = tuple((k.expr, k.ascending) for k in self._sort_keys())
        self.expect_sign(")")
        if self.accept("WITHIN"):
            self.expect("GROUP")
            self.expect_sign("(")
            self.expect("ORDER", "BY")
            order = tuple((k.expr, k.ascending) for k in self._sort_keys())
            self.expect_sign(")")
        where = None
        if self.accept("FILTER"):
            self.expect_sign("(")
            self.expect("WHERE")
            where = self.expr()
            self.expect_sign(")")
        over = None
        if self.is_word("OVER") and self.is_sign("(", 1):
            self.at += 2
            keys = self._sort_keys() if self.accept("ORDER", "BY") else []
            before = None
            if self.accept("ROWS"):
                self.expect("BETWEEN")
                if self.accept("UNBOUNDED", "PRECEDING"):
                    before = None
                elif self.accept("CURRENT", "ROW"):
                    before = 0
                else:
                    before = self._number()
                    self.expect("PRECEDING")
                self.expect("AND")
                self.expect("CURRENT", "ROW")
            self.expect_sign(")")
            over = tuple((k.expr, k.ascending) for k in keys), before
        return Call(name, tuple(args), None, distinct, order, where, over)


def with_semantics(e: Expr, word: str) -> Expr:
    if isinstance(e, Call):
        if e.name in ("PREV", "NEXT"):
            raise QueryError(f"{word} can't stand before {e.name}")
        return Call(e.name, e.args, word, e.distinct, e.order, e.where, e.over)
    if isinstance(e, Col):
        return Call("LAST", (e,), word)
    raise QueryError(f"{word} must stand before a function")


def permuted(items: list[Pattern]) -> Pattern:
    """All orders of items, those of the declared order first."""
    if len(items) > MAX_PERMUTE:
        raise QueryError(f"PERMUTE of more than {MAX_PERMUTE} elements")
    branches = 1
    for k in range(2, len(items) + 1):
        branches *= k
    if branches > MAX_BRANCHES:
        raise QueryError("PERMUTE has too many branches")
    if len(items) == 1:
        return items[0]
    return Alt(tuple(Seq(tuple(p)) for p in itertools.permutations(items)))


def parse(sql: str) -> Query:
    return Parser(sql).query()


def parse_clause(text: str) -> Clause:
    """The inside of MATCH_RECOGNIZE( ... )."""
    p = Parser(text)
    c = p.clause()
    if p.token.kind != "end":
        p.fail("the end of the clause")
    return c
