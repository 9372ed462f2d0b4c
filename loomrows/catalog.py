"""Queries of the row pattern engine, by name, each with the DuckDB SQL that
gives the same rows. DuckDB has no MATCH_RECOGNIZE: where rows carry one label,
the oracle spells a partition as a string of symbols and matches it with a
regular expression; stateful conditions are walked by a recursive query."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import match_recognize

FLAGSHIP = "one_row_sequence"

KIND = "CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'P' WHEN 'signup' THEN 'S' ELSE 'E' END"
DEFINE = "V AS event_type = 'view', C AS event_type = 'click', P AS event_type = 'purchase', S AS event_type = 'signup', E AS event_type = 'error'"
BY = "PARTITION BY user_id ORDER BY ts, event_id"


@dataclasses.dataclass
class Entry:
    table: str
    sql: str
    oracle: str
    after: Callable[[DataFrame], DataFrame] | None = None


ENTRIES: dict[str, Entry] = {}


def define(*names: str) -> str:
    """Conditions of the event variables that a pattern uses."""
    return ", ".join(d for d in DEFINE.split(", ") if d[0] in names)


def spelled(regex: str, symbol: str = KIND, table: str = "events", part: str = "user_id", order: str = "ts, event_id", where: str = "true") -> str:
    """CTEs o (rows with rn), found (part, match_no, a, b, txt: matches) and r
    (rows of matches with label)."""
    return f"""o AS (SELECT *, {symbol} AS sym, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {table} WHERE {where}),
    words AS (SELECT {part}, string_agg(sym, '' ORDER BY rn) AS s FROM o GROUP BY {part}),
    cut AS (SELECT {part}, regexp_extract_all(s, '{regex}') AS ms, string_split_regex(s, '{regex}') AS gs FROM words),
    found AS (SELECT {part}, i AS match_no, ms[i] AS txt, a, a + length(ms[i]) - 1 AS b FROM (SELECT *, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) + 1 AS BIGINT) AS a FROM cut, unnest(range(1, len(ms) + 1)) AS t(i))),
    r AS (SELECT o.*, match_no, a, b, substr(txt, rn - a + 1, 1) AS lab FROM o JOIN found USING ({part}) WHERE rn BETWEEN a AND b)"""


def one(name: str, pattern: str, regex: str, measures: str, select: str, names: str, extra: str = "", skip: str = "PAST LAST ROW") -> None:
    """An ONE ROW query over events; select: the oracle's columns per match."""
    cols = ", ".join("m." + m.rsplit(" AS ", 1)[1] for m in measures.split("; "))
    sql = f"SELECT m.user_id, {cols} FROM events MATCH_RECOGNIZE ({BY} MEASURES {measures.replace('; ', ', ')} ONE ROW PER MATCH AFTER MATCH SKIP {skip} PATTERN ({pattern}) {extra} DEFINE {define(*names)}) AS m"
    ENTRIES[name] = Entry("events", sql, f"WITH {spelled(regex)} SELECT user_id, {select} FROM r GROUP BY user_id, match_no")


SPAN = "FIRST(event_id) AS first_id; LAST(event_id) AS last_id; COUNT(*) AS n; MATCH_NUMBER() AS match_no"
SPAN_SQL = "arg_min(event_id, rn) AS first_id, arg_max(event_id, rn) AS last_id, count(*) AS n, match_no"

one("one_row_sequence", "V+ C+", "V+C+", "FIRST(V.event_id) AS first_view; LAST(C.event_id) AS last_click; COUNT(*) AS n; MATCH_NUMBER() AS match_no", "arg_min(event_id, rn) AS first_view, arg_max(event_id, rn) AS last_click, count(*) AS n, match_no", "VC")
one("alternation", "V (C | P)+ E", "V[CP]+E", SPAN, SPAN_SQL, "VCPE")
one("bounded_quantifiers", "V{1,5} C* P+", "V{1,5}C*P+", SPAN, SPAN_SQL, "VCP")
one("optional_parts", "V+ C? P*", "V+C?P*", SPAN, SPAN_SQL, "VCP")
one("nested_groups", "(V | C)+ (P{1,3} E*)+", "[VC]+(?:P{1,3}E*)+", SPAN, SPAN_SQL, "VCPE")
one("reluctant_quantifiers", "(V | C)+? P{1,3}?", "[VC]+?P{1,3}?", SPAN, SPAN_SQL, "VCP")
one("exact_and_open_bounds", "V{2} (C | P | E){2,}", "V{2}[CPE]{2,}", SPAN, SPAN_SQL, "VCPE")
one("permute", "PERMUTE(V, C, P)", "VCP|VPC|CVP|CPV|PVC|PCV", SPAN + "; CLASSIFIER() AS last_label", SPAN_SQL + ", arg_max(lab, rn) AS last_label", "VCP")
one("start_anchor", "^(V | C)+", "^[VC]+", SPAN, SPAN_SQL, "VC")
one("end_anchor", "(P | E)+ $", "[PE]+$", SPAN, SPAN_SQL, "PE")
one("whole_partition", "^ (V | C | P | S | E)+ $", "^[VCPSE]+$", SPAN, SPAN_SQL, "VCPSE")
one("union_variables", "V+ (C | P)+", "V+[CP]+", "COUNT(U.*) AS n_u; FIRST(U.event_id) AS first_u; LAST(U.event_id) AS last_u; CLASSIFIER(U) AS label_u; SUM(U.event_id) AS sum_u", "count(*) FILTER (WHERE lab IN ('C','P')) AS n_u, arg_min(event_id, rn) FILTER (lab IN ('C','P')) AS first_u, arg_max(event_id, rn) AS last_u, arg_max(lab, rn) AS label_u, CAST(sum(event_id) FILTER (lab IN ('C','P')) AS BIGINT) AS sum_u", "VCP", "SUBSET U = (C, P)")
one("offset_navigation", "V (V | C | P){2,6}", "V[VCP]{2,6}", "FIRST(event_id, 1) AS second_id; LAST(event_id, 1) AS before_last; LAST(event_id, 50) AS none_id; FIRST(V.event_id) AS first_v; LAST(V.event_id) AS last_v", "arg_min(event_id, rn) FILTER (rn = a + 1) AS second_id, arg_min(event_id, rn) FILTER (rn = b - 1) AS before_last, CAST(NULL AS BIGINT) AS none_id, arg_min(event_id, rn) FILTER (lab = 'V') AS first_v, arg_max(event_id, rn) FILTER (lab = 'V') AS last_v", "VCP")
one("aggregates", "V (C | P)+", "V[CP]+", "COUNT(value) AS n; SUM(event_id) AS total; MIN(event_id) AS low; MAX(event_id) AS high; AVG(event_id % 10) AS mean; COUNT(DISTINCT event_type) AS kinds; ARRAY_AGG(event_id) AS ids; STRING_AGG(event_type, '>') AS path; BOOL_OR(event_type = 'purchase') AS bought; BOOL_AND(event_id > 0) AS positive", "count(value) AS n, CAST(sum(event_id) AS BIGINT) AS total, min(event_id) AS low, max(event_id) AS high, avg(event_id % 10) AS mean, count(DISTINCT event_type) AS kinds, list(event_id ORDER BY rn) AS ids, string_agg(event_type, '>' ORDER BY rn) AS path, bool_or(event_type = 'purchase') AS bought, bool_and(event_id > 0) AS positive", "VCP")
one("aggregates_of_variables", "V+ C+ P*", "V+C+P*", "COUNT(V.*) AS n_v; COUNT(P.event_id) AS n_p; SUM(C.event_id) AS sum_c; SUM(P.event_id) AS sum_p; MAX(V.event_id) - MIN(V.event_id) AS spread; COALESCE(SUM(P.event_id), 0) - SUM(C.event_id) AS diff", "count(*) FILTER (WHERE lab = 'V') AS n_v, count(*) FILTER (WHERE lab = 'P') AS n_p, CAST(sum(event_id) FILTER (lab = 'C') AS BIGINT) AS sum_c, CAST(sum(event_id) FILTER (lab = 'P') AS BIGINT) AS sum_p, max(event_id) FILTER (lab = 'V') - min(event_id) FILTER (lab = 'V') AS spread, CAST(coalesce(sum(event_id) FILTER (lab = 'P'), 0) - sum(event_id) FILTER (lab = 'C') AS BIGINT) AS diff", "VCP")
one("conditional_aggregates", "V (C | P | E)+", "V[CPE]+", "COUNT_IF(event_type = 'click') AS clicks; SUM_IF(event_id, event_type = 'purchase') AS bought; SUM(event_id) FILTER (WHERE event_type <> 'view') AS rest; MAX_BY(event_type, event_id) AS at_high; MIN_BY(event_type, event_id) AS at_low; APPROX_DISTINCT(event_type) AS kinds; FIRST_VALUE(event_type) AS fv; LAST_VALUE(event_type) AS lv", "count(*) FILTER (WHERE event_type = 'click') AS clicks, CAST(sum(event_id) FILTER (event_type = 'purchase') AS BIGINT) AS bought, CAST(sum(event_id) FILTER (event_type <> 'view') AS BIGINT) AS rest, max_by(event_type, event_id) AS at_high, min_by(event_type, event_id) AS at_low, count(DISTINCT event_type) AS kinds, arg_min(event_type, rn) AS fv, arg_max(event_type, rn) AS lv", "VCPE")
one("statistical_aggregates", "V (C | P | E){2,}", "V[CPE]{2,}", "ROUND(STDDEV_SAMP(event_id % 7) * 1000 + 0.0137) AS sd; ROUND(VAR_POP(event_id % 7) * 1000 + 0.0137) AS vp; APPROX_PERCENTILE(event_id % 7, 0.5) AS med; MEDIAN(event_id % 7) AS med2", "round_even(stddev_samp(event_id % 7) * 1000 + 0.0137, 0) AS sd, round_even(var_pop(event_id % 7) * 1000 + 0.0137, 0) AS vp, quantile_cont(event_id % 7, 0.5) AS med, quantile_cont(event_id % 7, 0.5) AS med2", "VCPE")
one("ordered_arrays", "V (C | P)+", "V[CP]+", "ARRAY_AGG(event_id ORDER BY event_id DESC) AS down; LISTAGG(event_type, ',') AS path; ARRAY_AGG(CLASSIFIER()) AS labels; ARRAY_AGG(C.event_id) AS clicks", "list(event_id ORDER BY event_id DESC) AS down, string_agg(event_type, ',' ORDER BY rn) AS path, list(lab ORDER BY rn) AS labels, list(event_id ORDER BY rn) FILTER (lab = 'C') AS clicks", "VCP")
one("scalar_functions", "V C", "VC", "UPPER(FIRST(event_type)) || '-' || LOWER(CLASSIFIER()) AS tag; ABS(FIRST(event_id) - LAST(event_id)) AS gap; MOD(LAST(event_id), 7) AS m7; SUBSTR(LAST(event_type), 2, 3) AS part; GREATEST(FIRST(event_id), LAST(event_id)) AS g; NULLIF(LAST(event_id) % 2, 0) AS odd; CAST(FIRST(event_id) AS VARCHAR(2)) AS two; CASE WHEN LAST(event_id) > 5000 THEN 'hi' ELSE 'lo' END AS size; LENGTH(LAST(event_type)) AS len; FLOOR(SQRT(LAST(event_id))) AS root", "upper(arg_min(event_type, rn)) || '-' || lower(arg_max(lab, rn)) AS tag, abs(arg_min(event_id, rn) - arg_max(event_id, rn)) AS gap, arg_max(event_id, rn) % 7 AS m7, substr(arg_max(event_type, rn), 2, 3) AS part, greatest(arg_min(event_id, rn), arg_max(event_id, rn)) AS g, nullif(arg_max(event_id, rn) % 2, 0) AS odd, left(CAST(arg_min(event_id, rn) AS VARCHAR), 2) AS two, CASE WHEN arg_max(event_id, rn) > 5000 THEN 'hi' ELSE 'lo' END AS size, length(arg_max(event_type, rn)) AS len, CAST(floor(sqrt(arg_max(event_id, rn))) AS BIGINT) AS root", "VC")


def every(name: str, pattern: str, regex: str, mode: str, measures: str, names: str, oracle: str, extra: str = "") -> None:
    cols = ", ".join("m." + m.rsplit(" AS ", 1)[1] for m in measures.split("; "))
    sql = f"SELECT m.user_id, m.event_id, {cols} FROM events MATCH_RECOGNIZE ({BY} MEASURES {measures.replace('; ', ', ')} ALL ROWS PER MATCH {mode} AFTER MATCH SKIP PAST LAST ROW PATTERN ({pattern}) {extra} DEFINE {define(*names)}) AS m"
    ENTRIES[name] = Entry("events", sql, f"WITH {spelled(regex)} {oracle}")


RUN = "OVER (PARTITION BY user_id, match_no ORDER BY rn)"
WHOLE = "OVER (PARTITION BY user_id, match_no)"
every("all_rows_labels", "V+ C+", "V+C+", "", "CLASSIFIER() AS label; MATCH_NUMBER() AS match_no; ROW_NUMBER() AS k", "VC", "SELECT user_id, event_id, lab AS label, match_no, rn - a + 1 AS k FROM r")
every("running_and_final", "V (C | P)+", "V[CP]+", "", "RUNNING COUNT(*) AS rc; FINAL COUNT(*) AS fc; RUNNING SUM(event_id) AS rs; FINAL SUM(event_id) AS fs; RUNNING MAX(event_id) AS rm; FINAL LAST(event_id) AS fl; RUNNING LAST(event_id) AS rl; RUNNING COUNT(C.*) AS rcc", "VCP", f"SELECT user_id, event_id, count(*) {RUN} AS rc, count(*) {WHOLE} AS fc, CAST(sum(event_id) {RUN} AS BIGINT) AS rs, CAST(sum(event_id) {WHOLE} AS BIGINT) AS fs, max(event_id) {RUN} AS rm, max_by(event_id, rn) {WHOLE} AS fl, event_id AS rl, count(*) FILTER (WHERE lab = 'C') {RUN} AS rcc FROM r")
every("running_arrays", "V (C | P)+", "V[CP]+", "", "RUNNING ARRAY_AGG(event_id) AS ids; RUNNING STRING_AGG(CLASSIFIER(), '') AS word", "VCP", f"SELECT user_id, event_id, list(event_id) {RUN} AS ids, substr(word, 1, CAST(rn - a + 1 AS INTEGER)) AS word FROM (SELECT r.*, string_agg(lab, '' ORDER BY rn) {WHOLE.replace(')', ' )')} AS word FROM r)".replace("string_agg(lab, '' ORDER BY rn) OVER (PARTITION BY user_id, match_no )", "string_agg(lab, '') OVER (PARTITION BY user_id, match_no ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
every("exclusion", "V {- C+ -} P", "VC+P", "", "CLASSIFIER() AS label; RUNNING COUNT(*) AS n", "VCP", "SELECT user_id, event_id, lab AS label, rn - a + 1 AS n FROM r WHERE lab <> 'C'")
every("unmatched_rows", "V C+", "VC+", "WITH UNMATCHED ROWS", "CLASSIFIER() AS label; MATCH_NUMBER() AS match_no", "VC", "SELECT o.user_id, o.event_id, r.lab AS label, r.match_no FROM o LEFT JOIN r ON o.user_id = r.user_id AND o.rn = r.rn")
every("physical_navigation", "V C+", "VC+", "", "PREV(event_id) AS p1; NEXT(event_id, 2) AS n2; PREV(FIRST(event_id)) AS before_match; NEXT(LAST(event_id)) AS nx; PREV(CLASSIFIER()) AS pl", "VC", "SELECT r.user_id, r.event_id, p1, n2, pm AS before_match, nm AS nx, CASE WHEN r.rn > a THEN lag(lab) OVER (PARTITION BY r.user_id ORDER BY r.rn) END AS pl FROM r JOIN (SELECT user_id, rn, lag(event_id) OVER w AS p1, lead(event_id) OVER w AS n1, lead(event_id, 2) OVER w AS n2 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY rn)) z ON z.user_id = r.user_id AND z.rn = r.rn LEFT JOIN (SELECT user_id, rn, event_id AS pm FROM o) f ON f.user_id = r.user_id AND f.rn = a - 1 LEFT JOIN (SELECT user_id, rn, event_id AS nm FROM o) e ON e.user_id = r.user_id AND e.rn = b + 1")

ISLANDS = f"""o AS (SELECT *, {KIND} AS sym, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    g AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, sym = 'V' ORDER BY rn) AS island FROM o),
    u AS (SELECT user_id, CASE WHEN sym = 'V' THEN 'v' || island ELSE 'e' || rn END AS key, min(rn) AS a, max(rn) AS b, count(*) FILTER (WHERE sym = 'V') AS n FROM g GROUP BY ALL),
    z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) AS match_no FROM u)"""
for mode, keep in (("ONE ROW PER MATCH", "true"), ("ALL ROWS PER MATCH SHOW EMPTY MATCHES", "true"), ("ALL ROWS PER MATCH OMIT EMPTY MATCHES", "n > 0")):
    whole = mode.startswith("ONE")
    name = "empty_matches_one_row" if whole else "empty_matches_shown" if "SHOW" in mode else "empty_matches_omitted"
    ENTRIES[name] = Entry(
        "events",
        f"SELECT m.user_id, m.match_no, m.n{'' if whole else ', m.event_id'} FROM events MATCH_RECOGNIZE ({BY} MEASURES MATCH_NUMBER() AS match_no, FINAL COUNT(*) AS n {mode} PATTERN (V*) DEFINE {define('V')}) AS m",
        f"WITH {ISLANDS} SELECT z.user_id, match_no, n FROM z" if whole else f"WITH {ISLANDS} SELECT z.user_id, match_no, n, event_id FROM z JOIN o ON o.user_id = z.user_id AND o.rn BETWEEN a AND b WHERE {keep}",
    )

ENTRIES["skip_to_next_row"] = Entry(
    "events",
    f"SELECT m.user_id, m.first_id, m.last_id FROM events MATCH_RECOGNIZE ({BY} MEASURES FIRST(event_id) AS first_id, LAST(event_id) AS last_id AFTER MATCH SKIP TO NEXT ROW PATTERN (V+ C) DEFINE {define('V', 'C')}) AS m",
    f"WITH {ISLANDS}, e AS (SELECT g.user_id, g.event_id AS first_id, max(rn) OVER (PARTITION BY user_id, island) + 1 AS nxt FROM g WHERE sym = 'V') SELECT e.user_id, first_id, o.event_id AS last_id FROM e JOIN o ON o.user_id = e.user_id AND o.rn = e.nxt WHERE o.sym = 'C'",
)
TRIPLE = f"WITH o AS (SELECT *, {KIND} AS sym FROM events), w AS (SELECT user_id, event_id AS a, sym AS s1, lead(event_id) OVER k AS b, lead(sym) OVER k AS s2, lead(event_id, 2) OVER k AS c, lead(sym, 2) OVER k AS s3 FROM o WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a) AS match_no, a AS first_id, c AS last_id FROM w WHERE s1 = 'V' AND s2 = 'C' AND s3 = 'V'"
for name, skip in (("skip_to_last_variable", "TO LAST W"), ("skip_to_variable", "TO W"), ("skip_to_first_variable", "TO FIRST W")):
    ENTRIES[name] = Entry("events", f"SELECT m.user_id, m.match_no, m.first_id, m.last_id FROM events MATCH_RECOGNIZE ({BY} MEASURES MATCH_NUMBER() AS match_no, FIRST(event_id) AS first_id, LAST(event_id) AS last_id AFTER MATCH SKIP {skip} PATTERN (V C W) DEFINE {define('V', 'C')}, W AS event_type = 'view') AS m", TRIPLE.replace("ORDER BY a)", "ORDER BY ts, event_id)").replace("AS (SELECT user_id, event_id AS a", "AS (SELECT user_id, ts, event_id, event_id AS a"))

SHAPE = "CASE WHEN o_totalprice < lag(o_totalprice) OVER w0 THEN 'D' WHEN o_totalprice > lag(o_totalprice) OVER w0 THEN 'U' ELSE 'N' END"
SHAPE = SHAPE.replace("OVER w0", "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
ENTRIES["price_valleys"] = Entry(
    "orders",
    "SELECT m.o_custkey, m.start_key, m.bottom_key, m.end_key, m.n FROM orders MATCH_RECOGNIZE (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey MEASURES A.o_orderkey AS start_key, LAST(B.o_orderkey) AS bottom_key, LAST(C.o_orderkey) AS end_key, COUNT(*) AS n ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW PATTERN (A B+ C+) DEFINE B AS B.o_totalprice < PREV(B.o_totalprice), C AS C.o_totalprice > PREV(C.o_totalprice)) AS m",
    f"WITH {spelled('.D+U+', SHAPE, 'orders', 'o_custkey', 'o_orderdate, o_orderkey')} SELECT o_custkey, arg_min(o_orderkey, rn) AS start_key, arg_max(o_orderkey, rn) FILTER (sym = 'D' AND rn > a) AS bottom_key, arg_max(o_orderkey, rn) AS end_key, count(*) AS n FROM r GROUP BY o_custkey, match_no",
)
PART_LINES = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber"
ENTRIES["predicates"] = Entry(
    "lineitem",
    f"SELECT m.l_suppkey, m.first_key, m.n FROM lineitem MATCH_RECOGNIZE ({PART_LINES} MEASURES FIRST(l_orderkey) AS first_key, COUNT(*) AS n PATTERN (A B+) DEFINE A AS l_quantity BETWEEN 10 AND 30 AND l_returnflag IN ('R', 'A'), B AS NOT (l_returnflag IN ('R', 'A')) AND l_comment_missing IS NULL AND CASE WHEN l_discount > 0.05 THEN l_quantity >= 5 ELSE l_quantity <> 7 END) AS m",
    "WITH {} SELECT l_suppkey, arg_min(l_orderkey, rn) AS first_key, count(*) AS n FROM r GROUP BY l_suppkey, match_no".format(spelled("AB+", "CASE WHEN l_quantity BETWEEN 10 AND 30 AND l_returnflag IN ('R','A') THEN 'A' WHEN l_returnflag NOT IN ('R','A') AND CASE WHEN l_discount > 0.05 THEN l_quantity >= 5 ELSE l_quantity <> 7 END THEN 'B' ELSE 'N' END", "lineitem", "l_suppkey", "l_shipdate, l_orderkey, l_linenumber")),
)
ENTRIES["arithmetic_predicates"] = Entry(
    "events",
    f"SELECT m.user_id, m.first_id, m.n FROM events MATCH_RECOGNIZE ({BY} MEASURES FIRST(event_id) AS first_id, COUNT(*) AS n PATTERN (A+ B) DEFINE A AS event_id % 3 = 0 OR event_id % 5 = 1, B AS ABS(event_id - NEXT(event_id)) >= 0 AND event_id * 2 - 1 > event_id / 2 AND NOT (event_id % 3 = 0 OR event_id % 5 = 1)) AS m",
    "WITH nx AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), {} SELECT user_id, arg_min(event_id, rn) AS first_id, count(*) AS n FROM r GROUP BY user_id, match_no".format(spelled("A+B", "CASE WHEN event_id % 3 = 0 OR event_id % 5 = 1 THEN 'A' WHEN nxt IS NOT NULL AND event_id * 2 - 1 > event_id / 2 THEN 'B' ELSE 'N' END", "nx")),
)
WALK = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), walk AS ({first} UNION ALL {step})"""
ENTRIES["stateful_sum"] = Entry(
    "events",
    f"SELECT m.user_id, m.match_no, m.first_id, m.n, m.total FROM events MATCH_RECOGNIZE ({BY} MEASURES MATCH_NUMBER() AS match_no, FIRST(event_id) AS first_id, COUNT(*) AS n, SUM(event_id % 7) AS total PATTERN (A+) DEFINE A AS SUM(A.event_id % 7) <= 12) AS m",
    WALK.format(first="SELECT user_id, rn, event_id, event_id % 7 AS t, CAST(1 AS BIGINT) AS m FROM o WHERE rn = 1", step="SELECT o.user_id, o.rn, o.event_id, CASE WHEN t + o.event_id % 7 <= 12 THEN t + o.event_id % 7 ELSE o.event_id % 7 END, CASE WHEN t + o.event_id % 7 <= 12 THEN m ELSE m + 1 END FROM walk JOIN o ON o.user_id = walk.user_id AND o.rn = walk.rn + 1") + " SELECT user_id, m AS match_no, arg_min(event_id, rn) AS first_id, count(*) AS n, CAST(sum(event_id % 7) AS BIGINT) AS total FROM walk GROUP BY user_id, m",
)
ENTRIES["back_references"] = Entry(
    "events",
    f"SELECT m.user_id, m.match_no, m.a_id, m.n FROM events MATCH_RECOGNIZE ({BY} MEASURES MATCH_NUMBER() AS match_no, FIRST(A.event_id) AS a_id, COUNT(*) AS n PATTERN (A B+) DEFINE A AS event_type = 'view', B AS B.event_id % 50 > A.event_id % 50) AS m",
    WALK.format(
        first="SELECT user_id, rn, CASE WHEN event_type = 'view' THEN event_id END AS a, CASE WHEN event_type = 'view' THEN rn END AS s, CAST(0 AS BIGINT) AS k FROM o WHERE rn = 1",
        step="SELECT o.user_id, o.rn, CASE WHEN a IS NOT NULL AND o.event_id % 50 > a % 50 THEN a WHEN event_type = 'view' THEN event_id END, CASE WHEN a IS NOT NULL AND o.event_id % 50 > a % 50 THEN s WHEN event_type = 'view' THEN o.rn END, CASE WHEN a IS NOT NULL AND o.event_id % 50 > a % 50 THEN k + 1 ELSE 0 END FROM walk JOIN o ON o.user_id = walk.user_id AND o.rn = walk.rn + 1",
    )
    + " SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s) AS match_no, a AS a_id, max(k) + 1 AS n FROM walk WHERE k > 0 GROUP BY user_id, s, a",
)
ENTRIES["order_by_expression"] = Entry(
    "events",
    f"SELECT m.user_id, m.first_id, m.last_id, m.n FROM events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY event_id % 10 DESC, -event_id MEASURES FIRST(event_id) AS first_id, LAST(event_id) AS last_id, COUNT(*) AS n PATTERN (V+ C) DEFINE {define('V', 'C')}) AS m",
    "WITH {} SELECT user_id, arg_min(event_id, rn) AS first_id, arg_max(event_id, rn) AS last_id, count(*) AS n FROM r GROUP BY user_id, match_no".format(spelled("V+C", order="event_id % 10 DESC, -event_id")),
)
ENTRIES["single_partition"] = Entry(
    "nation",
    "SELECT m.first_name, m.last_name, m.n FROM nation MATCH_RECOGNIZE (ORDER BY n_nationkey MEASURES FIRST(n_name) AS first_name, LAST(n_name) AS last_name, COUNT(*) AS n PATTERN (A B*) DEFINE B AS B.n_regionkey >= PREV(B.n_regionkey)) AS m",
    "WITH p AS (SELECT *, CASE WHEN n_regionkey >= lag(n_regionkey) OVER (ORDER BY n_nationkey) THEN 0 ELSE 1 END AS fresh FROM nation), q AS (SELECT *, sum(fresh) OVER (ORDER BY n_nationkey) AS g FROM p) SELECT arg_min(n_name, n_nationkey) AS first_name, arg_max(n_name, n_nationkey) AS last_name, count(*) AS n FROM q GROUP BY g",
)
ENTRIES["row_pattern_window"] = Entry(
    "events",
    f"SELECT user_id, event_id, ids OVER w, n OVER w FROM events WINDOW w AS ({BY} MEASURES ARRAY_AGG(event_id) AS ids, COUNT(*) AS n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING AFTER MATCH SKIP TO NEXT ROW SEEK PATTERN (C P) DEFINE {define('C', 'P')})",
    f"WITH o AS (SELECT *, {KIND} AS sym FROM events), w AS (SELECT *, lead(event_id) OVER k AS nid, lead(sym) OVER k AS nsym FROM o WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT *, CASE WHEN sym = 'C' AND nsym = 'P' THEN [event_id, nid] END AS pair FROM w), j AS (SELECT user_id, event_id, first_value(pair IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ids FROM h) SELECT user_id, event_id, ids, CASE WHEN ids IS NOT NULL THEN CAST(2 AS BIGINT) END AS n FROM j",
)
_VALUES = "(VALUES {v}) t(id) MATCH_RECOGNIZE (ORDER BY id MEASURES CLASSIFIER() AS label, id AS val ALL ROWS PER MATCH PATTERN ({p}) DEFINE {p} AS {c}) AS {a}"
ENTRIES["cross_join_of_clauses"] = Entry("", "SELECT one.label AS l1, one.val AS v1, two.val AS v2 FROM " + _VALUES.format(v="(1), (2), (3)", p="A", c="id > 1", a="one") + ", " + _VALUES.format(v="(10), (20)", p="B", c="true", a="two"), "SELECT 'A' AS l1, CAST(x AS BIGINT) AS v1, CAST(y AS BIGINT) AS v2 FROM (VALUES (2), (3)) a(x), (VALUES (10), (20)) b(y)")
ENTRIES["subqueries"] = Entry(
    "events",
    f"SELECT m.user_id, m.last_id, m.flag FROM events MATCH_RECOGNIZE ({BY} MEASURES FINAL LAST(event_id + (SELECT 1000)) AS last_id, LAST(A.event_id < 0 OR EXISTS(SELECT 1)) AS flag PATTERN (A+) DEFINE A AS event_type IN ('view', 'click') AND 1 IN (SELECT 1)) AS m",
    "WITH {} SELECT user_id, arg_max(event_id, rn) + 1000 AS last_id, true AS flag FROM r GROUP BY user_id, match_no".format(spelled("[VC]+")),
)
ENTRIES["select_star_layout"] = Entry("events", f"SELECT * FROM events MATCH_RECOGNIZE ({BY} MEASURES CLASSIFIER() AS label ALL ROWS PER MATCH PATTERN (V C) DEFINE {define('V', 'C')}) AS m", "WITH {} SELECT user_id, ts, event_id, lab AS label, event_type, value, props FROM r".format(spelled("VC")))
ENTRIES["outer_order_and_limit"] = Entry("events", f"SELECT m.user_id, m.n, m.first_id FROM events MATCH_RECOGNIZE ({BY} MEASURES COUNT(*) AS n, FIRST(event_id) AS first_id PATTERN (V+ C+) DEFINE {define('V', 'C')}) AS m ORDER BY n DESC, first_id", f"WITH {spelled('V+C+')} SELECT user_id, count(*) AS n, arg_min(event_id, rn) AS first_id FROM r GROUP BY user_id, match_no ORDER BY n DESC, first_id LIMIT 20", lambda df: df.limit(20))
ENTRIES["composed_with_aggregation"] = Entry("events", f"SELECT m.user_id, m.n FROM events MATCH_RECOGNIZE ({BY} MEASURES COUNT(*) AS n PATTERN (V+ (C | P)) DEFINE {define('V', 'C', 'P')}) AS m", f"WITH {spelled('V+[CP]')}, z AS (SELECT user_id, count(*) AS n FROM r GROUP BY user_id, match_no) SELECT user_id, count(*) AS matches, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS longest FROM z GROUP BY user_id", lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("matches"), F.sum("n").alias("n_rows"), F.max("n").alias("longest")))
ENTRIES["chained_clauses"] = Entry(
    "events",
    f"SELECT m.user_id, m.k, m.n FROM events MATCH_RECOGNIZE ({BY} MEASURES MATCH_NUMBER() AS k, COUNT(*) AS n PATTERN (V+) DEFINE {define('V')}) AS m",
    f"WITH {spelled('V+')}, z AS (SELECT user_id, match_no AS k, count(*) AS n FROM r GROUP BY user_id, match_no), y AS (SELECT *, CASE WHEN n > lag(n) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM z), q AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY k) AS g FROM y) SELECT user_id, min(k) AS first_k, count(*) AS runs FROM q GROUP BY user_id, g HAVING count(*) > 1",
    lambda df: match_recognize("SELECT m.user_id, m.first_k, m.runs FROM x MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY k MEASURES FIRST(k) AS first_k, COUNT(*) AS runs PATTERN (A B+) DEFINE B AS B.n > PREV(B.n)) AS m", df),
)
ENTRIES["conversation_turns"] = Entry(
    "conversations",
    "SELECT m.conv_id, m.first_turn, m.pairs FROM conversations MATCH_RECOGNIZE (PARTITION BY conv_id ORDER BY turn MEASURES FIRST(turn) AS first_turn, COUNT(A.*) AS pairs PATTERN ((U A)+) DEFINE U AS role = 'user', A AS role = 'assistant') AS m",
    "WITH {} SELECT conv_id, arg_min(turn, rn) AS first_turn, count(*) FILTER (WHERE lab = 'A') AS pairs FROM r GROUP BY conv_id, match_no".format(spelled("(?:UA)+", "CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'N' END", "conversations", "conv_id", "turn")),
)

# functions of measures, conditions and keys

R3 = "round_even({} * 1000 + 0.0137, 0) AS {}"
M3 = "ROUND({} * 1000 + 0.0137) AS {}"


def rounded(pairs: dict[str, tuple[str, str]]) -> tuple[str, str]:
    """Measures and oracle columns from name: (measure, SQL), in thousandths."""
    return "; ".join(M3.format(m, n) for n, (m, _) in pairs.items()), ", ".join(R3.format(q, n) for n, (_, q) in pairs.items())


_A, _B = "arg_min(event_id, rn)", "arg_max(event_id, rn)"
one("moments_and_means", "V (C | P | E){2,}", "V[CPE]{2,}", *rounded({
    "sd": ("STDDEV(event_id % 7)", "stddev_samp(event_id % 7)"), "sdp": ("STDDEV_POP(event_id % 7)", "stddev_pop(event_id % 7)"), "v1": ("VARIANCE(event_id % 7)", "var_samp(event_id % 7)"), "v2": ("VAR_SAMP(event_id % 7)", "var_samp(event_id % 7)"), "v3": ("VAR(event_id % 7)", "var_samp(event_id % 7)"),
    "q1": ("PERCENTILE_APPROX(event_id % 7, 0.25)", "quantile_cont(event_id % 7, 0.25)"), "gm": ("GEOMETRIC_MEAN(event_id % 7 + 1)", "exp(avg(ln(event_id % 7 + 1)))"), "hm": ("HARMONIC_MEAN(event_id % 7 + 1)", "count(*) / sum(1.0::DOUBLE / (event_id % 7 + 1))"),
    "cv": ("COVAR(event_id % 7, event_id % 5)", "covar_samp(event_id % 7, event_id % 5)"), "cr": ("CORR(event_id % 7, event_id % 5)", "CASE WHEN count(DISTINCT event_id % 7) > 1 AND count(DISTINCT event_id % 5) > 1 THEN corr(event_id % 7, event_id % 5) END"),
}), "VCPE")
one("choosing_aggregates", "V (C | P | E){1,4}", "V[CPE]{1,4}", "COUNT_DISTINCT(event_type) AS kinds; ARBITRARY(event_type) AS some; AVG_IF(event_id, event_type = 'purchase') AS bought; LAG(event_id) AS lg; LEAD(event_id) AS ld; LEAD(event_id, 50, -1) AS far; LAG(event_id, 4) AS l4; FIRST_VALUE(event_type) OVER (ORDER BY event_id DESC) AS fv; LAST_VALUE(event_id) OVER (ORDER BY event_id) AS lv; IF(LAST(event_id) > FIRST(event_id), 'up', 'down') AS way; SUM_IF(event_id, event_type = 'none') AS none; COUNT_IF(event_id % 2 = 0) AS even",
    f"count(DISTINCT event_type) AS kinds, arg_min(event_type, rn) AS some, avg(event_id) FILTER (event_type = 'purchase') AS bought, arg_min(event_id, rn) FILTER (rn = b - 1) AS lg, arg_min(event_id, rn) FILTER (rn = a + 1) AS ld, CAST(-1 AS BIGINT) AS far, arg_min(event_id, rn) FILTER (rn = b - 4) AS l4, arg_max(event_type, event_id) AS fv, max(event_id) AS lv, CASE WHEN {_B} > {_A} THEN 'up' ELSE 'down' END AS way, CAST(NULL AS BIGINT) AS none, count(*) FILTER (event_id % 2 = 0) AS even", "VCPE")
_X = "(FIRST(event_id) % 11 + 1)", "(arg_min(event_id, rn) % 11 + 1)"
one("mathematics", "V C", "VC", *(a + b for a, b in zip(rounded({f.lower(): (f"{f}({_X[0]})", f"{q or f}({_X[1]})") for f, q in (("EXP", ""), ("LN", ""), ("LOG10", ""), ("SQRT", ""), ("SIN", ""), ("COS", ""), ("TAN", ""), ("ATAN", ""), ("DEGREES", ""), ("RADIANS", ""))} | {
    "lg": (f"LOG({_X[0]})", f"log10({_X[1]})"), "lg2": (f"LOG({_X[0]}, 2)", f"log2({_X[1]})"), "asn": (f"ASIN({_X[0]} / 12)", f"asin({_X[1]} / 12)"), "acs": (f"ACOS({_X[0]} / 12)", f"acos({_X[1]} / 12)"), "at2": (f"ATAN2({_X[0]}, 3)", f"atan2({_X[1]}, 3)"),
}), ("; POWER(FIRST(event_id) % 5, 3) AS cube; CEIL(FIRST(event_id) / 2) AS up; CEILING(FIRST(event_id) / 3) AS up3; FLOOR(LAST(event_id) / 2) AS down; TRUNCATE(LAST(event_id) / 8, 1) AS cut; SIGN(FIRST(event_id) - LAST(event_id)) AS sg; ROUND(FIRST(event_id) / 8, 1) AS near; FIRST(event_id) ** 2 AS sq; LAST(event_id) // 7 AS whole; FIRST(event_id) & 6 | 1 << 3 AS bits", f", CAST(pow({_A} % 5, 3) AS BIGINT) AS cube, CAST(ceil({_A} / 2) AS BIGINT) AS up, CAST(ceil({_A} / 3) AS BIGINT) AS up3, CAST(floor({_B} / 2) AS BIGINT) AS down, trunc({_B} / 8 * 10) / 10 AS cut, CAST(sign({_A} - {_B}) AS BIGINT) AS sg, round_even({_A} / 8, 1) AS near, {_A} * {_A} AS sq, {_B} // 7 AS whole, ({_A} & 6) | 8 AS bits"))), "VC")
one("text_functions", "V (C | P)", "V[CP]", "TRIM('  ' || LAST(event_type) || ' ') AS t; LTRIM('  x ') AS lt; RTRIM(' x  ') AS rt; REPLACE(LAST(event_type), 'c', '_') AS rp; LEFT(LAST(event_type), 2) AS lf; RIGHT(LAST(event_type), 3) AS rg; CONCAT(FIRST(event_type), '-', LAST(event_type)) AS cc; CONCAT_WS('/', FIRST(event_type), LAST(event_type)) AS cw; SUBSTRING(LAST(event_type), -3) AS tl; LEAST(FIRST(event_type), LAST(event_type)) AS le; CONCAT_WS('', ARRAY_AGG(CLASSIFIER())) AS word",
    "arg_max(event_type, rn) AS t, 'x ' AS lt, ' x' AS rt, replace(arg_max(event_type, rn), 'c', '_') AS rp, left(arg_max(event_type, rn), 2) AS lf, right(arg_max(event_type, rn), 3) AS rg, arg_min(event_type, rn) || '-' || arg_max(event_type, rn) AS cc, arg_min(event_type, rn) || '/' || arg_max(event_type, rn) AS cw, right(arg_max(event_type, rn), 3) AS tl, least(arg_min(event_type, rn), arg_max(event_type, rn)) AS le, string_agg(lab, '' ORDER BY rn) AS word", "VCP")
one("conversions", "V C+", "VC+", "TRY_CAST(FIRST(event_type) AS BIGINT) AS bad; CAST('12' AS INTEGER) + LAST(event_id) AS n; CAST(FIRST(event_id) AS DOUBLE) / 2 AS half; CAST(LAST(event_id) AS VARCHAR) AS txt; CAST(FIRST(ts) AS DATE) AS day; ISFINITE(LAST(event_id) / 2) AS fin; ISNAN(LAST(event_id) / 2) AS nan; ISINF(LAST(event_id) / 2) AS inf; ARRAY[FIRST(event_id), LAST(event_id)] AS ends; ISREAL(1.5) AS re",
    f"CAST(NULL AS BIGINT) AS bad, 12 + {_B} AS n, {_A} / 2 AS half, CAST({_B} AS VARCHAR) AS txt, CAST(arg_min(ts, rn) AS DATE) AS day, true AS fin, false AS nan, false AS inf, [{_A}, {_B}] AS ends, true AS re", "VC")
one("dates", "V C+", "VC+", "YEAR(FIRST(ts)) AS y; EXTRACT(MONTH FROM LAST(ts)) AS mo; EXTRACT(DAY FROM LAST(ts)) AS d; HOUR(LAST(ts)) AS h; EXTRACT(MINUTE FROM LAST(ts)) AS mi; SECOND(FIRST(ts)) AS s; NOW() > FIRST(ts) AS past; CURRENT_TIMESTAMP > LAST(ts) AS past2; CURRENT_DATE > CAST(FIRST(ts) AS DATE) AS past3; LENGTH(CURRENT_TIME) > 4 AS clock",
    ", ".join(f"CAST({part}(arg_{end}(ts, rn)) AS BIGINT) AS {n}" for part, end, n in (("year", "min", "y"), ("month", "max", "mo"), ("day", "max", "d"), ("hour", "max", "h"), ("minute", "max", "mi"), ("second", "min", "s"))) + ", true AS past, true AS past2, true AS past3, true AS clock", "VC")
every("references_in_rows", "V C+", "VC+", "", "FIRST(event_id * 2 + 1) AS fx; LAST(event_id, 99) AS far; RUNNING FIRST(event_id, 1) AS second_id; PREV(event_id, 500) AS before; RUNNING SUM(event_id) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS pair", "VC", f"SELECT user_id, event_id, min_by(event_id, rn) {WHOLE} * 2 + 1 AS fx, CAST(NULL AS BIGINT) AS far, CASE WHEN rn > a THEN nth_value(event_id, 2) {RUN} END AS second_id, CAST(NULL AS BIGINT) AS before, CAST(event_id + coalesce(lag(event_id) {RUN}, 0) AS BIGINT) AS pair FROM r")
one("nested_permute", "PERMUTE(V, PERMUTE(C, P))", "VCP|VPC|CPV|PCV", SPAN + "; CLASSIFIER() AS last_label", SPAN_SQL + ", arg_max(lab, rn) AS last_label", "VCP")
ENTRIES["patterns_of_text"] = Entry(
    "events",
    f"SELECT m.user_id, m.first_id, m.n FROM events MATCH_RECOGNIZE ({BY} MEASURES FIRST(event_id) AS first_id, COUNT(*) AS n PATTERN (A B+) DEFINE A AS event_type LIKE 'v%' AND event_id NOT IN (), B AS B.event_type LIKE '%l_ck' AND LAG(event_type) LIKE '%i%' AND NOT (event_id IN ())) AS m",
    f"WITH {spelled('VC+')} SELECT user_id, arg_min(event_id, rn) AS first_id, count(*) AS n FROM r GROUP BY user_id, match_no",
)
ENTRIES["lag_and_lead_in_conditions"] = Entry(
    "events",
    f"SELECT m.user_id, m.event_id FROM events MATCH_RECOGNIZE ({BY} MEASURES CLASSIFIER() AS c ALL ROWS PER MATCH PATTERN (A) DEFINE A AS LAG(event_type, 2, 'none') = 'none' AND LEAD(event_type) = 'click' OR LAG(event_type) = 'signup' AND LEAD(event_id, 3) IS NULL) AS m",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, lag(event_type, 2, 'none') OVER w AS p2, lead(event_type) OVER w AS n1, lag(event_type) OVER w AS p1, lead(event_id, 3) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p2 = 'none' AND n1 = 'click' OR p1 = 'signup' AND n3 IS NULL",
)
ENTRIES["alternative_of_nothing"] = Entry(
    "events",
    f"SELECT m.user_id, m.match_no, m.n, m.c FROM events MATCH_RECOGNIZE ({BY} MEASURES MATCH_NUMBER() AS match_no, COUNT(*) AS n, CLASSIFIER() AS c PATTERN (V | ()) DEFINE {define('V')}) AS m",
    f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS match_no, CAST(event_type = 'view' AS BIGINT) AS n, CASE WHEN event_type = 'view' THEN 'V' END AS c FROM events",
)
ENTRIES["empty_loops"] = Entry("events", f"SELECT m.user_id, m.first_id, m.n FROM events MATCH_RECOGNIZE ({BY} MEASURES FIRST(event_id) AS first_id, COUNT(*) AS n PATTERN (V (C* | ())* P) DEFINE {define('V', 'C', 'P')}) AS m", f"WITH {spelled('VC*P')} SELECT user_id, arg_min(event_id, rn) AS first_id, count(*) AS n FROM r GROUP BY user_id, match_no")
ENTRIES["case_of_labels"] = Entry("events", f"SELECT m.user_id, m.event_id, m.label FROM events MATCH_RECOGNIZE ({BY} MEASURES CLASSIFIER() AS label ALL ROWS PER MATCH PATTERN (v \"c\"+ Ab) DEFINE v AS event_type = 'view', \"c\" AS event_type = 'click', Ab AS event_type = 'purchase') AS m", f"WITH {spelled('VC+P')} SELECT user_id, event_id, CASE lab WHEN 'V' THEN 'v' WHEN 'C' THEN 'c' ELSE 'Ab' END AS label FROM r")
for name, order, key in (("nulls_first", "value % 3 NULLS FIRST, event_id", "value % 3 NULLS FIRST, event_id"), ("nulls_last", "value % 3 DESC NULLS LAST, event_id DESC", "value % 3 DESC NULLS LAST, event_id DESC")):
    ENTRIES[name] = Entry("events", f"SELECT m.user_id, m.first_id, m.last_id, m.n FROM events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY {order} MEASURES FIRST(event_id) AS first_id, LAST(event_id) AS last_id, COUNT(*) AS n PATTERN (V+ C) DEFINE {define('V', 'C')}) AS m".replace("value % 3", "COALESCE(NULL_VALUE, NULL_VALUE)"), "WITH nv AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN event_id % 3 END AS null_value FROM events), {} SELECT user_id, arg_min(event_id, rn) AS first_id, arg_max(event_id, rn) AS last_id, count(*) AS n FROM r GROUP BY user_id, match_no".format(spelled("V+C", order=key.replace("value % 3", "null_value"), table="nv")))
ENTRIES["where_and_limit"] = Entry("events", f"SELECT DISTINCT m.user_id, m.n, m.first_id FROM events MATCH_RECOGNIZE ({BY} MEASURES COUNT(*) AS n, FIRST(event_id) AS first_id, LAST(event_type) AS kind PATTERN (V+ (C | P)+) DEFINE {define('V', 'C', 'P')}) AS m WHERE m.n > 2 AND kind LIKE 'cl%' ORDER BY n DESC, first_id LIMIT 25", f"WITH {spelled('V+[CP]+')} SELECT user_id, count(*) AS n, arg_min(event_id, rn) AS first_id FROM r GROUP BY user_id, match_no HAVING count(*) > 2 AND arg_max(event_type, rn) LIKE 'cl%' ORDER BY n DESC, first_id LIMIT 25")
ENTRIES["long_overlapping_matches"] = Entry(
    "events",
    f"SELECT m.user_id, m.first_id, m.last_id, m.n FROM events MATCH_RECOGNIZE ({BY} MEASURES FIRST(event_id) AS first_id, LAST(event_id) AS last_id, COUNT(*) AS n AFTER MATCH SKIP TO NEXT ROW PATTERN (A+) DEFINE A AS event_id >= 0) AS m",
    "SELECT user_id, event_id AS first_id, last_value(event_id) OVER w AS last_id, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
)


def _query(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{entry.table}.parquet") if entry.table else None
        if "l_comment_missing" in entry.sql:
            df = df.withColumn("l_comment_missing", F.lit(None).cast("string"))
        if "NULL_VALUE" in entry.sql:
            df = df.withColumn("null_value", F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 3))
        out = match_recognize(entry.sql, df, spark)
        return entry.after(out) if entry.after else out

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(e) for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.oracle for name, e in ENTRIES.items()}
