"""The entry points: match_recognize(sql, df), and a clause over a DataFrame."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import Local, to_column
from .plans.ast import Call, Clause, Col, Expr, Query, QueryError, SortKey, Source, Star
from .plans.parser import parse, parse_clause
from .plans.planner import Planner, fold
from .sources.values import values_frame


def match_recognize(sql: str, df: DataFrame | None = None, spark: SparkSession | None = None, standard_semantics: bool = False) -> DataFrame:
    """Runs a row pattern query.

    Args:
        sql: SELECT ... FROM relation MATCH_RECOGNIZE ( ... ) [ORDER BY ...], the
            WINDOW ... SEEK form, or several clauses over VALUES. DISTINCT,
            WHERE, ORDER BY and LIMIT work on the rows of the clause.
        df: the relation of FROM, whatever its name there; without it the name
            is looked up as a table or view.
        standard_semantics: measures of ALL ROWS PER MATCH are RUNNING unless
            they say FINAL, as the standard has it.
    """
    query = parse(sql)
    spark = spark or (df.sparkSession if df is not None else SparkSession.getActiveSession())

    def relation(s: Source) -> DataFrame:
        if s.rows is not None:
            return values_frame(spark, s.rows, s.columns)
        return df if df is not None else spark.table(s.table)

    if query.windows:
        from .operators.window import window_query

        return window_query(query, relation(query.sources[0]), standard_semantics)
    if any(s.clause is None for s in query.sources):
        raise QueryError("FROM needs a MATCH_RECOGNIZE clause")
    if len(query.sources) == 1:
        s = query.sources[0]
        out = _select(query.items, Planner(s.clause, relation(s), standard_semantics), s, query.where)
    else:
        joined = None
        if query.where is not None:
            raise QueryError("WHERE takes one clause; filter the result of several as a DataFrame")
        aliases = [s.alias for s in query.sources]
        if None in aliases or len(set(aliases)) < len(aliases):
            raise QueryError("each of several clauses needs an alias of its own")
        for s in query.sources:
            part = run_clause(s.clause, relation(s), standard_semantics)
            part = part.toDF(*(f"{s.alias}.{c}" for c in part.columns))
            if joined is not None:
                warnings.warn("several clauses in FROM give all pairs of their rows", stacklevel=2)
            joined = part if joined is None else joined.crossJoin(part)
        out = _project(query.items, joined)
    return _finished(out, query)


def _finished(out: DataFrame, query: Query) -> DataFrame:
    out = _sorted(out.distinct() if query.distinct else out, query.order_by)
    return out if query.limit is None else out.limit(query.limit)


def run_clause(clause: Clause | str, df: DataFrame, standard_semantics: bool = False) -> DataFrame:
    """All columns of a clause's result (those of SELECT *)."""
    clause = parse_clause(clause) if isinstance(clause, str) else clause
    return _select([(Star(), None)], Planner(clause, df, standard_semantics), Source(None))


def _select(items, planner: Planner, source: Source, where: Expr | None = None) -> DataFrame:
    layout = planner.layout()
    measures = [n for _, n in planner.clause.measures]
    wanted: list[tuple[str, str, str]] = []  # kind, name, shown
    for e, alias in items:
        if isinstance(e, Star):
            wanted += [(kind, name, name) for kind, name in layout]
            continue
        if not isinstance(e, Col):
            raise QueryError("SELECT takes columns and measures; compose expressions with the DataFrame API")
        if name := fold(e.name, measures):
            wanted.append(("measure", name, alias or e.name))
        elif name := fold(e.name, planner.columns):
            wanted.append(("in", name, alias or e.name))
        else:
            raise QueryError(f"no such column or measure: {e.name}")
    output = list(dict.fromkeys(name for kind, name, _ in wanted if kind == "in"))

    def column(n: str) -> str | None:
        return f"m_{m}" if (m := fold(n, measures)) else fold(n, output)

    for x in where.walk() if where is not None else ():
        if isinstance(x, Col) and not fold(x.name, measures):
            if (name := fold(x.name, planner.columns)) is None:
                raise QueryError(f"no such column or measure: {x.name}")
            output += [name] * (name not in output)
    done = planner.build(output)
    if where is not None:
        condition = to_column(where, Local(done.schema, column, lambda v: v == source.alias, None))
        if condition is None:
            raise QueryError("WHERE can't be evaluated; filter the result as a DataFrame")
        done = done.where(condition)
    return done.select(*(F.col(f"`{name}`" if kind == "in" else f"`m_{name}`").alias(shown) for kind, name, shown in wanted))


def _project(items, joined: DataFrame) -> DataFrame:
    out = []
    for e, alias in items:
        if isinstance(e, Star):
            out += [F.col(f"`{c}`") for c in joined.columns if e.var is None or c.startswith(f"{e.var}.")]
            continue
        if not isinstance(e, Col) or e.var is None:
            raise QueryError("with several clauses, SELECT takes alias.column")
        name = fold(f"{e.var}.{e.name}", joined.columns)
        if name is None:
            raise QueryError(f"no such column: {e.var}.{e.name}")
        out.append(F.col(f"`{name}`").alias(alias or e.name))
    return joined.select(*out)


def _sorted(out: DataFrame, keys: list[SortKey]) -> DataFrame:
    cols = []
    for k in keys:
        name = fold(k.expr.name, out.columns) if isinstance(k.expr, Col) else None
        if name is None:
            raise QueryError(f"ORDER BY {k.text}: not a column of the result")
        c = F.col(f"`{name}`")
        cols.append((c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()) if k.ascending else (c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()))
    return out.orderBy(*cols) if cols else out


def formatted(df: DataFrame, most: int = 1000) -> str:
    """The first ``most`` rows as a table of text, with a line that counts them."""
    rows = df.limit(most + 1).collect()
    cells = [df.columns, *([("NULL" if v is None else str(v)) for v in r] for r in rows[:most])]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    more = f"more than {most}" if len(rows) > most else str(len(rows))
    return "\n".join([line(cells[0]), "-+-".join("-" * w for w in widths), *map(line, cells[1:]), f"({more} row{'s' * (len(rows) != 1)})"])


__all__ = ["Call", "formatted", "match_recognize", "run_clause"]
