"""Aggregates over the rows of a match."""

from __future__ import annotations

import math
import statistics


def _nums(values):
    return [float(v) if isinstance(v, str) else v for v in values if v is not None]


def _distinct(values):
    out, seen = [], set()
    for v in values:
        key = tuple(v) if isinstance(v, list) else v
        if key not in seen:
            seen.add(key)
            out.append(v)
    return out


def _sum(v):
    return sum(v[1:], v[0]) if v else None


def _mixed(f):
    def run(v):
        try:
            return f(v) if v else None
        except TypeError:
            return f(map(str, v))

    return run


def _percentile(v, p):
    if not v or p is None or not 0 <= p <= 1:
        return None
    v = sorted(v)
    at = p * (len(v) - 1)
    low = math.floor(at)
    return float(v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low]))


def _moment(least, f, root=False):
    def run(v):
        if len(v) < least:
            return None
        x = f([float(n) for n in v])
        return math.sqrt(x) if root else x

    return run


def _geometric(v):
    return math.exp(sum(map(math.log, v)) / len(v)) if v and min(v) > 0 else None


def _harmonic(v):
    return len(v) / sum(1 / x for x in v) if v and min(v) > 0 else None


#: name: (function of the values without NULLs, whether they must be numbers)
ONE = {
    "COUNT": (len, False), "SUM": (_sum, True), "AVG": (lambda v: _sum(v) / len(v) if v else None, True), "MIN": (_mixed(min), False), "MAX": (_mixed(max), False),
    "ARRAY_AGG": (lambda v: list(v) or None, False), "APPROX_DISTINCT": (lambda v: len(_distinct(v)), False), "COUNT_DISTINCT": (lambda v: len(_distinct(v)), False), "ARBITRARY": (lambda v: v[0] if v else None, False), "ANY_VALUE": (lambda v: v[0] if v else None, False),
    "BOOL_AND": (lambda v: all(v), False), "BOOL_OR": (lambda v: any(v), False), "COUNT_IF": (lambda v: sum(map(bool, v)), False), "MEDIAN": (lambda v: float(statistics.median(v)) if v else None, True),
    "STDDEV": (_moment(2, statistics.variance, True), True), "STDDEV_SAMP": (_moment(2, statistics.variance, True), True), "STDDEV_POP": (_moment(1, statistics.pvariance, True), True),
    "VARIANCE": (_moment(2, statistics.variance), True), "VAR": (_moment(2, statistics.variance), True), "VAR_SAMP": (_moment(2, statistics.variance), True), "VAR_POP": (_moment(1, statistics.pvariance), True),
    "GEOMETRIC_MEAN": (_geometric, True), "HARMONIC_MEAN": (_harmonic, True), "FIRST_VALUE": (lambda v: v[0] if v else None, False), "LAST_VALUE": (lambda v: v[-1] if v else None, False),
}


def _pairs(a, b):
    return [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]


def _corr(a, b):
    p = _pairs(a, b)
    if len(p) < 2 or len({x for x, _ in p}) < 2 or len({y for _, y in p}) < 2:
        return None
    return statistics.correlation([float(x) for x, _ in p], [float(y) for _, y in p])


def _covar(a, b):
    p = _pairs(a, b)
    return statistics.covariance([float(x) for x, _ in p], [float(y) for _, y in p]) if len(p) > 1 else None


#: name: function of two value lists, NULLs included
TWO = {
    "MAX_BY": lambda a, b: max(_pairs(a, b), key=lambda p: p[1], default=(None,))[0],
    "MIN_BY": lambda a, b: min(_pairs(a, b), key=lambda p: p[1], default=(None,))[0],
    "SUM_IF": lambda a, b: _sum([x for x, y in zip(a, b, strict=True) if y and x is not None]),
    "AVG_IF": lambda a, b: (lambda v: _sum(v) / len(v) if v else None)([x for x, y in zip(a, b, strict=True) if y and x is not None]),
    "CORR": _corr, "COVAR": _covar, "COVAR_SAMP": _covar,
}
#: aggregates whose second argument is a constant
CONSTANT = {"STRING_AGG", "LISTAGG", "APPROX_PERCENTILE", "PERCENTILE_APPROX", "LAG", "LEAD"}
NAMES = {*ONE, *TWO, *CONSTANT}
#: what DEFINE keeps running totals of
INCREMENTAL = {"COUNT", "SUM", "MIN", "MAX", "AVG"}


def aggregate(name: str, columns: list[list], distinct: bool = False):
    """The value of an aggregate over lists of argument values, one per argument."""
    values = columns[0]
    if name in TWO:
        return TWO[name](columns[0], columns[1])
    live = [v for v in values if v is not None and v == v]
    if distinct:
        live = _distinct(live)
    if name in ("STRING_AGG", "LISTAGG"):
        sep = columns[1][0] if len(columns) > 1 and columns[1] else ","
        return sep.join(map(str, live)) if live else None
    if name in ("APPROX_PERCENTILE", "PERCENTILE_APPROX"):
        return _percentile(_nums(live), columns[1][0] if columns[1] else None)
    if name in ("LAG", "LEAD"):
        k = int(columns[1][0]) if len(columns) > 1 and columns[1] else 1
        at = len(values) - 1 - k if name == "LAG" else k
        default = columns[2][0] if len(columns) > 2 and columns[2] else None
        return values[at] if 0 <= at < len(values) else default
    f, numeric = ONE[name]
    return f(_nums(live) if numeric else live)


def supported() -> list[str]:
    return sorted(NAMES)


def signature(name: str) -> str:
    name = name.upper()
    if name not in NAMES:
        raise ValueError(f"{name} is no supported aggregate")
    if name in TWO:
        return f"{name}(x, y)"
    return f"{name}(x, constant)" if name in CONSTANT else f"{name}(x)" if name != "COUNT" else "COUNT(* | x | v.*)"
