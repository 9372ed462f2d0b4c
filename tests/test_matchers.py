"""The native matcher, the automaton and Python's regular expressions agree."""

import random
import re

import numpy as np
import pytest

from loomrows.operators import program as P
from loomrows.plans.parser import parse_clause

NAMES = "ABC"


def made(r, depth=0):
    kind = r.randrange(5 if depth < 3 else 1)
    if kind == 0:
        return r.choice(NAMES)
    if kind == 1:
        return " ".join(made(r, depth + 1) for _ in range(r.randint(2, 3)))
    if kind == 2:
        return "(" + " | ".join(made(r, depth + 1) for _ in range(r.randint(2, 3))) + ")"
    item = "(" + made(r, depth + 1) + ")"
    return item + r.choice(["*", "+", "?", "{2}", "{1,3}", "{,2}", "{2,}", "*?", "+?", "??", "{1,2}?"])


@pytest.mark.parametrize("seed", range(8))
def test_matchers_agree_on_random_patterns(seed):
    r = random.Random(seed)
    label, tried = {n: k for k, n in enumerate(NAMES)}, 0
    while tried < 40:
        text = made(r)
        pattern = parse_clause(f"PATTERN ({text}) DEFINE A AS true").pattern
        if P.nullable(pattern):
            continue
        try:
            automaton = P.Automaton(pattern, label)
        except P.PatternLimitError:
            continue
        tried += 1
        symbols = np.array([r.choice([0, 0, 1, 1, 2, 3, 4]) for _ in range(60)], np.uint8)
        got = P.marked_matches(P.regex_of(pattern, label), symbols)
        # patterns are read with blanks between variables, regular expressions without
        own = [m.span() for m in re.finditer(re.sub(r"\{,", "{0,", text.replace(" ", "").replace("(", "(?:")), "".join("ABC.!"[k] for k in symbols))]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == automaton.matches(symbols.tobytes()) == own, text
        ends = {}
        for a in range(60):
            m = re.compile(re.sub(r"\{,", "{0,", text.replace(" ", "").replace("(", "(?:"))).match("".join("ABC.!"[k] for k in symbols), a)
            if m:
                ends[a] = m.end()
        assert dict(automaton.overlapping(symbols.tobytes())) == ends, text


def test_what_the_native_matcher_refuses_goes_on_with_the_automaton():
    pattern = parse_clause("PATTERN (A{1001} B) DEFINE A AS true").pattern
    label = {"A": 0, "B": 1}
    symbols = np.array([0] * 1001 + [1], np.uint8)
    assert P.marked_matches(P.regex_of(pattern, label), symbols) is None
    assert P.Automaton(pattern, label).matches(symbols.tobytes()) == [(0, 1002)]
