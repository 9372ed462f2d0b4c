"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h, s FROM s),
c AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM n WHERE n > 0 GROUP BY h),
e AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
g AS (SELECT rep AS node, rep AS root FROM c UNION SELECT l.b, g.root FROM g JOIN l ON l.a = g.node),
k AS (SELECT node, min(root) AS component FROM g GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(k.component, n.doc_id) AS component_id, coalesce(k.component, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN c ON n.n > 0 AND c.h = n.h LEFT JOIN k ON k.node = c.rep
"""

_ESCAPED = r"regexp_replace({x}, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"
OP3 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  CAST(sum(length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")}) + 32) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""


def _op10() -> str:
    rules = quality.RULES
    gone = lambda chars: f"length(translate(coalesce(text, ''), '{chars}', ''))"
    whole = "length(coalesce(text, ''))"
    cells = " UNION ALL ".join(f"SELECT stratum, good, '{rule}' AS rule, {i} AS step, CAST({cut} AS DOUBLE) AS cutoff, {score.replace(' / ', ' * 1.0 / ')} > {cut} AS hit FROM labelled" for rule, (score, grid) in rules.items() for i, cut in enumerate(grid))
    p = quality.ALPHA / len(rules)
    level = f"{quality.DELTA} / (strata * {len(rules)})"
    reject = " OR ".join(f"coalesce({score.replace(' / ', ' * 1.0 / ')} > c_{rule}, false)" for rule, (score, _) in rules.items())
    pick = ", ".join(f"max(cutoff) FILTER (rule = '{rule}') AS c_{rule}" for rule in rules)
    return f"""
WITH w AS (SELECT row_number() OVER () AS uid, doc_id, lang AS stratum, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT uid, i, w[i:i+4] AS v FROM w, unnest(range(1, len(w) - 3)) t(i)),
rep AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, v) AS k FROM win) WHERE k > 1),
cov AS (SELECT uid, count(DISTINCT i + d) AS r FROM rep, unnest(range(0, 5)) t(d) GROUP BY uid),
ln AS (SELECT uid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
f AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST({gone(' ')} - length(regexp_replace({"text"}, '[^\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST({whole} - {gone(quality.SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(l) AS n_lines, {whole} - {gone(quality.CAPITALS)} AS n_capitals FROM w JOIN ln USING (uid) LEFT JOIN cov USING (uid)),
good AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT f.*, good FROM f JOIN good USING (doc_id)),
total AS (SELECT stratum, count(*) FILTER (good) AS n FROM labelled GROUP BY stratum),
cells AS ({cells}),
sums AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (hit AND good) AS k, count(*) FILTER (hit AND NOT good) AS bad FROM cells GROUP BY ALL),
tails AS (SELECT sums.*, (SELECT count(*) FROM total) AS strata, CASE WHEN k >= n * {p} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM unnest(range(0, k + 1)) t(i)) END AS tail FROM sums JOIN total ON sums.stratum IS NOT DISTINCT FROM total.stratum),
walk AS (SELECT *, max(CASE WHEN tail > {level} THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS failed FROM tails),
best AS (SELECT stratum, rule, arg_max(cutoff, bad * 1000 - step) AS cutoff FROM walk WHERE failed = 0 AND bad > 0 GROUP BY stratum, rule),
cut AS (SELECT stratum, {pick} FROM best GROUP BY stratum),
judged AS (SELECT f.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {reject} AS rejected FROM f LEFT JOIN cut ON f.stratum IS NOT DISTINCT FROM cut.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
""".replace("greatest(n_words, 1)", "greatest(n_words, 1)")


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op3_chat_format": OP3, "op10_quality_rules": _op10()}
