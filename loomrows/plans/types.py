"""Types of measures, told before anything runs."""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import types as T

from .ast import Array, Call, Case, Cast, Col, Expr, Lit, Op

_LONG = {"COUNT", "COUNT_IF", "APPROX_DISTINCT", "COUNT_DISTINCT", "MATCH_NUMBER", "ROW_NUMBER", "LENGTH", "CEILING", "CEIL", "FLOOR", "SIGN", "YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"}
_DOUBLE = {"AVG", "AVG_IF", "STDDEV", "STDDEV_SAMP", "STDDEV_POP", "VARIANCE", "VAR", "VAR_SAMP", "VAR_POP", "APPROX_PERCENTILE", "PERCENTILE_APPROX", "GEOMETRIC_MEAN", "HARMONIC_MEAN", "MEDIAN", "CORR", "COVAR", "COVAR_SAMP", "SQRT", "EXP", "LN", "LOG", "LOG10", "SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "ATAN2", "DEGREES", "RADIANS"}
_TEXT = {"CLASSIFIER", "STRING_AGG", "LISTAGG", "LOWER", "UPPER", "SUBSTR", "SUBSTRING", "CONCAT", "CONCAT_WS", "TRIM", "LTRIM", "RTRIM", "LEFT", "RIGHT", "REPLACE", "CURRENT_TIME"}
_BOOL = {"BOOL_AND", "BOOL_OR", "ISFINITE", "ISNAN", "ISINF", "ISREAL"}
_CAST = {"BIGINT": T.LongType(), "INTEGER": T.LongType(), "INT": T.LongType(), "SMALLINT": T.LongType(), "TINYINT": T.LongType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampNTZType()}


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType) or a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DecimalType(38, 10) if not isinstance(a, T.FractionalType) or not isinstance(b, T.FractionalType) or isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType) else T.DoubleType()
        return T.DoubleType() if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)) else T.LongType()
    return T.StringType()


def _literal(v) -> T.DataType:
    if v is None:
        return T.NullType()
    kinds = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (decimal.Decimal, T.DecimalType(38, 10)), (dt.datetime, T.TimestampNTZType()), (dt.date, T.DateType()))
    return next((k for t, k in kinds if isinstance(v, t)), T.StringType())


def type_of(e: Expr, column) -> T.DataType:
    """column(name): the type of an input column, or None."""
    sub = lambda x: type_of(x, column)
    if isinstance(e, Lit):
        return _literal(e.value)
    if isinstance(e, Col):
        kind = column(e.name) or T.NullType()
        return T.LongType() if isinstance(kind, (T.ByteType, T.ShortType)) else kind
    if isinstance(e, Op):
        if e.name in ("+", "-", "*", "%", "//", "**"):
            return _whole(wider(sub(e.args[0]), sub(e.args[1])))
        if e.name in ("&", "|", "^", "<<", ">>"):
            return T.LongType()
        if e.name == "/":
            kind = wider(sub(e.args[0]), sub(e.args[1]))
            return kind if isinstance(kind, T.DecimalType) else T.DoubleType()
        if e.name == "NEG":
            return sub(e.args[0])
        if e.name == "||":
            kind = sub(e.args[0])
            return kind if isinstance(kind, T.ArrayType) else T.StringType()
        return T.BooleanType()
    if isinstance(e, Case):
        out: T.DataType = T.NullType()
        for x in [v for _, v in e.whens] + ([e.other] if e.other else []):
            out = wider(out, sub(x))
        return out
    if isinstance(e, Cast):
        if e.kind in ("DECIMAL", "NUMERIC"):
            return T.DecimalType(e.params[0] if e.params else 38, e.params[1] if len(e.params) > 1 else 0)
        return _CAST.get(e.kind, T.StringType())
    if isinstance(e, Array):
        out = T.NullType()
        for x in e.items:
            out = wider(out, sub(x))
        return T.ArrayType(out)
    if isinstance(e, Call):
        n = e.name
        if n in _LONG:
            return T.LongType()
        if n in _DOUBLE:
            kind = sub(e.args[0]) if e.args and n == "AVG" else None
            return kind if isinstance(kind, T.DecimalType) else T.DoubleType()
        if n in _TEXT:
            return T.StringType()
        if n in _BOOL:
            return T.BooleanType()
        if n in ("SUM", "SUM_IF"):
            kind = sub(e.args[0])
            return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else _whole(kind) if isinstance(kind, T.NumericType) else T.DoubleType()
        if n == "ARRAY_AGG":
            return T.ArrayType(sub(e.args[0]))
        if n in ("COALESCE", "GREATEST", "LEAST"):
            out = T.NullType()
            for x in e.args:
                out = wider(out, sub(x))
            return out
        if n == "IF":
            return wider(sub(e.args[1]), sub(e.args[2]) if len(e.args) > 2 else T.NullType())
        if n == "ROUND" and isinstance(sub(e.args[0]), T.IntegralType):
            return T.LongType()
        if n in ("CURRENT_DATE",):
            return T.DateType()
        if n in ("NOW", "CURRENT_TIMESTAMP"):
            return T.TimestampNTZType()
        if n in ("POWER", "POW", "MOD"):
            return _whole(wider(sub(e.args[0]), sub(e.args[1])))
        return sub(e.args[0]) if e.args else T.NullType()
    return T.NullType()


def _whole(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType() if isinstance(kind, (T.FloatType, T.NullType)) else kind


def shown(kind: T.DataType) -> T.DataType:
    """A type that can be written: unknown ones become text."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(shown(kind.elementType))
    return kind
