"""Scalar functions as the kernel evaluates them: any NULL argument gives NULL,
except in COALESCE, NULLIF, IF and CASE; errors give NULL."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import operator
import re


def is_null(x) -> bool:
    return x is None or isinstance(x, float) and x != x


def _number(x):
    return float(x) if isinstance(x, str) else x


def _round(x, k=0):
    return round(x, int(k)) if k else (round(x) if isinstance(x, int) else float(round(x)))


def _truncate(x, k=0):
    f = 10 ** int(k)
    return type(x)(math.trunc(x * f) / f) if isinstance(x, float) else math.trunc(x * f) // f


def _substr(s, start, n=None):
    at = int(start) - 1 if start > 0 else len(s) + int(start) if start < 0 else 0
    return s[max(at, 0) :] if n is None else s[max(at, 0) : max(at, 0) + max(int(n), 0)]


def _text(x) -> str:
    return ("true" if x else "false") if isinstance(x, bool) else str(x)


def _concat_ws(sep, *parts):
    if len(parts) == 1 and isinstance(parts[0], list):
        parts = tuple(p for p in parts[0] if p is not None)
    return sep.join(map(_text, parts))


FUNCTIONS = {
    "ABS": abs, "ROUND": _round, "TRUNCATE": _truncate, "TRUNC": _truncate, "CEILING": math.ceil, "CEIL": math.ceil, "FLOOR": math.floor, "SQRT": math.sqrt, "POWER": operator.pow, "POW": operator.pow, "EXP": math.exp, "LN": math.log,
    "LOG": lambda x, b=10: math.log(x, b), "LOG10": math.log10, "MOD": operator.mod, "SIGN": lambda x: (x > 0) - (x < 0),
    "SIN": math.sin, "COS": math.cos, "TAN": math.tan, "ASIN": math.asin, "ACOS": math.acos, "ATAN": math.atan, "ATAN2": math.atan2, "DEGREES": math.degrees, "RADIANS": math.radians,
    "LENGTH": len, "LOWER": str.lower, "UPPER": str.upper, "SUBSTR": _substr, "SUBSTRING": _substr, "CONCAT": lambda *a: "".join(map(_text, a)), "CONCAT_WS": _concat_ws,
    "TRIM": str.strip, "LTRIM": str.lstrip, "RTRIM": str.rstrip, "LEFT": lambda s, n: s[: int(n)], "RIGHT": lambda s, n: s[-int(n) :] if n else s, "REPLACE": lambda s, a, b="": s.replace(a, b),
    "LEAST": min, "GREATEST": max, "ISFINITE": math.isfinite, "ISNAN": math.isnan, "ISINF": math.isinf, "ISREAL": math.isfinite,
    "NOW": lambda: dt.datetime.now(), "CURRENT_DATE": dt.date.today, "CURRENT_TIMESTAMP": lambda: dt.datetime.now(), "CURRENT_TIME": lambda: dt.datetime.now().time().isoformat(),
    "EXTRACT_YEAR": lambda x: x.year, "YEAR": lambda x: x.year, "MONTH": lambda x: x.month, "DAY": lambda x: x.day, "HOUR": lambda x: x.hour, "MINUTE": lambda x: x.minute, "SECOND": lambda x: x.second,
}

_CAST = {"BIGINT": "int", "INTEGER": "int", "INT": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float", "REAL": "float", "FLOAT": "float", "VARCHAR": "str", "CHAR": "str", "TEXT": "str", "STRING": "str", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "timestamp", "DATETIME": "timestamp", "DECIMAL": "decimal", "NUMERIC": "decimal"}


def cast(x, kind: str, params: tuple = ()):
    """x as kind; NULL where that fails."""
    if is_null(x):
        return None
    try:
        to = _CAST[kind]
        if to == "int":
            return int(float(x)) if isinstance(x, str) and not re.fullmatch(r"\s*[-+]?\d+\s*", x) else int(x)
        if to == "float":
            return float(x)
        if to == "str":
            s = _text(x)
            return s if not params else s[: params[0]].ljust(params[0]) if kind == "CHAR" else s[: params[0]]
        if to == "bool":
            return {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}[x.strip().lower()] if isinstance(x, str) else bool(x)
        if to == "date":
            return x.date() if isinstance(x, dt.datetime) else x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)[:10])
        if to == "timestamp":
            return x if isinstance(x, dt.datetime) else dt.datetime.fromisoformat(str(x))
        scale = params[1] if len(params) > 1 else 0
        return decimal.Decimal(str(x)).quantize(decimal.Decimal(1).scaleb(-scale))
    except Exception:
        return None


def _plain(f):
    def run(a, b):
        if is_null(a) or is_null(b):
            return None
        try:
            return f(a, b)
        except Exception:
            return None

    return run


def _compare(f):
    def run(a, b):
        if is_null(a) or is_null(b):
            return None
        try:
            return f(a, b)
        except TypeError:
            try:
                return f(_number(a), _number(b))
            except Exception:
                return False

    return run


def like(s, pattern):
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), s, re.S) is not None


BINARY = {
    "+": _plain(operator.add), "-": _plain(operator.sub), "*": _plain(operator.mul), "/": _plain(operator.truediv), "//": _plain(operator.floordiv), "%": _plain(operator.mod), "**": _plain(operator.pow),
    "&": _plain(operator.and_), "|": _plain(operator.or_), "^": _plain(operator.xor), "<<": _plain(operator.lshift), ">>": _plain(operator.rshift),
    "||": _plain(lambda a, b: a + b if isinstance(a, list) else _text(a) + _text(b)), "LIKE": _plain(like),
    "=": _compare(operator.eq), "<>": _compare(operator.ne), "<": _compare(operator.lt), "<=": _compare(operator.le), ">": _compare(operator.gt), ">=": _compare(operator.ge),
}
