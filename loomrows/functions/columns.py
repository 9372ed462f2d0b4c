"""Expressions as Spark columns, for conditions that depend on the row and on
rows at a fixed distance only. ``to_column`` returns None where it can't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..plans.ast import Array, Call, Case, Cast, Col, Expr, Lit, Op


class Local:
    """The names of one variable's condition: columns of df, own qualifiers."""

    def __init__(self, schema: T.StructType, resolve, own, window: WindowSpec | None):
        self.schema, self.resolve, self.own, self.window = schema, resolve, own, window

    def is_own(self, var: str | None) -> bool:
        return var is None or self.own(var)


def _null_if_any(args: list[Column], value: Column) -> Column:
    missing = args[0].isNull()
    for a in args[1:]:
        missing = missing | a.isNull()
    return F.when(missing, F.lit(None)).otherwise(value)


def _log(args):
    return F.log10(args[0].cast("double")) if len(args) == 1 else F.log(args[0].cast("double")) * 0 + F.log(args[0].cast("double")) / F.log(args[1].cast("double"))


_FUNCTIONS = {
    "ABS": lambda a: F.abs(a[0]), "CEILING": lambda a: F.ceil(a[0]), "CEIL": lambda a: F.ceil(a[0]), "FLOOR": lambda a: F.floor(a[0]), "SQRT": lambda a: F.sqrt(F.when(a[0] >= 0, a[0])), "POWER": lambda a: F.pow(a[0], a[1]), "POW": lambda a: F.pow(a[0], a[1]),
    "EXP": lambda a: F.exp(a[0]), "LN": lambda a: F.log(F.when(a[0] > 0, a[0].cast("double"))), "LOG10": lambda a: F.log10(F.when(a[0] > 0, a[0].cast("double"))), "SIGN": lambda a: F.signum(a[0]),
    "SIN": lambda a: F.sin(a[0]), "COS": lambda a: F.cos(a[0]), "TAN": lambda a: F.tan(a[0]), "ATAN": lambda a: F.atan(a[0]), "ATAN2": lambda a: F.atan2(a[0], a[1]), "DEGREES": lambda a: F.degrees(a[0]), "RADIANS": lambda a: F.radians(a[0]),
    "LENGTH": lambda a: F.char_length(a[0]), "LOWER": lambda a: F.lower(a[0]), "UPPER": lambda a: F.upper(a[0]), "TRIM": lambda a: F.trim(a[0]), "LTRIM": lambda a: F.ltrim(a[0]), "RTRIM": lambda a: F.rtrim(a[0]), "CONCAT": lambda a: F.concat(*a),
    "REPLACE": lambda a: F.replace(*a), "COALESCE": lambda a: F.coalesce(*a), "NULLIF": lambda a: F.nullif(a[0], a[1]), "GREATEST": lambda a: _null_if_any(a, F.greatest(*a)), "LEAST": lambda a: _null_if_any(a, F.least(*a)),
    "MOD": lambda a: _mod(a[0], a[1]), "YEAR": lambda a: F.year(a[0]), "MONTH": lambda a: F.month(a[0]), "DAY": lambda a: F.dayofmonth(a[0]), "HOUR": lambda a: F.hour(a[0]), "MINUTE": lambda a: F.minute(a[0]), "SECOND": lambda a: F.second(a[0]),
}
_KINDS = {"BIGINT": "bigint", "INTEGER": "bigint", "INT": "bigint", "DOUBLE": "double", "REAL": "double", "FLOAT": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}


def _mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return F.try_mod(F.try_mod(a, b) + b, b)


def to_column(e: Expr, local: Local, shift: int = 0) -> Column | None:
    sub = lambda x: to_column(x, local, shift)
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Col):
        if not local.is_own(e.var):
            return None
        name = local.resolve(e.name)
        if name is None:
            return F.lit(None)
        c = F.col(f"`{name}`")
        kind = local.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif not isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
            return None
        if shift and local.window is not None:
            c = F.lag(c, -shift).over(local.window) if shift < 0 else F.lead(c, shift).over(local.window)
        return c
    if isinstance(e, Op):
        args = [sub(a) for a in e.args]
        if e.name == "LIKE" and isinstance(e.args[1], Lit) and isinstance(e.args[1].value, str) and args[0] is not None:
            return args[0].like(e.args[1].value.replace("\\", "\\\\"))
        if any(a is None for a in args):
            return None
        return _operator(e.name, args)
    if isinstance(e, Case):
        whens = [(sub(c), sub(v)) for c, v in e.whens]
        other = sub(e.other) if e.other else F.lit(None)
        if other is None or any(c is None or v is None for c, v in whens):
            return None
        out = F.when(*whens[0])
        for c, v in whens[1:]:
            out = out.when(c, v)
        return out.otherwise(other)
    if isinstance(e, Cast):
        a = sub(e.arg)
        return a.try_cast(_KINDS[e.kind]) if a is not None and e.kind in _KINDS and not e.params else None
    if isinstance(e, Array):
        return None
    if isinstance(e, Call):
        if e.distinct or e.order or e.where or e.over or e.semantics:
            return None
        if e.name in ("PREV", "NEXT", "LAG", "LEAD"):
            ahead = e.name in ("NEXT", "LEAD")
            if not 1 <= len(e.args) <= 2 or len(e.args) == 2 and not (isinstance(e.args[1], Lit) and isinstance(e.args[1].value, int) and e.args[1].value >= 0):
                return None
            n = e.args[1].value if len(e.args) == 2 else 1
            if local.window is None or any(isinstance(x, Call) for x in e.args[0].walk()):
                return None
            return to_column(e.args[0], local, shift + (n if ahead else -n))
        if e.name in _FUNCTIONS:
            args = [sub(a) for a in e.args]
            if not args or any(a is None for a in args):
                return None
            try:
                return _FUNCTIONS[e.name](args)
            except (IndexError, TypeError):
                return None
    return None


def _operator(name: str, a: list[Column]) -> Column | None:
    if name == "AND":
        return a[0] & a[1]
    if name == "OR":
        return a[0] | a[1]
    if name == "NOT":
        return ~a[0]
    if name == "NEG":
        return -a[0]
    if name == "ISNULL":
        return a[0].isNull()
    if name == "IN":
        return a[0].isin(a[1:]) if len(a) > 1 else F.lit(False)
    if name == "/":
        return F.try_divide(a[0].cast("double"), a[1].cast("double"))
    if name == "%":
        return _mod(a[0], a[1])
    if name == "||":
        return F.concat(a[0].cast("string"), a[1].cast("string"))
    if name == "**":
        return F.pow(a[0], a[1])
    if name in ("LIKE", "<<", ">>"):
        return None
    if name in ("&", "|", "^"):
        return getattr(a[0], {"&": "bitwiseAND", "|": "bitwiseOR", "^": "bitwiseXOR"}[name])(a[1])
    ops = {"=": lambda: a[0] == a[1], "<>": lambda: a[0] != a[1], "<": lambda: a[0] < a[1], "<=": lambda: a[0] <= a[1], ">": lambda: a[0] > a[1], ">=": lambda: a[0] >= a[1], "+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1]}
    return ops[name]() if name in ops else None
