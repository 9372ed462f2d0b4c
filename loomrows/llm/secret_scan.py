"""Secret scans: candidate strings, and a random forest that drops false ones.

Candidates are values assigned to names such as token or password, passwords in
addresses, private key blocks, and runs of key characters of at least
``SHORTEST`` with a digit or a known beginning (a shorter bare run can't be told
from a word or number and is none). Candidates have no greatest length. Where
they overlap, the kind that knows more (in this order: block, address, assigned,
known beginning, run) keeps its place and the other what is left of it, if that
is a candidate still.

A random forest, trained here from labelled findings, judges each by its length,
entropy, character transitions (log-probability of its letter pairs under those
of words, and changes of class), coverage by dictionary words, known beginnings,
the path (a column, if named) and the neighbouring words. The findings are
drawn by a seeded generator (``labelled_findings``) that writes keys, tokens and
passwords as they occur in text and code, with paths, and the usual false
alarms: hashes of commits and files, identifiers, card and phone numbers,
placeholders, encoded data, long words. ``train`` takes any such list, so own
findings can be used instead.

Scanning reads each whole text once, without a shuffle; a text without a long
word that holds a digit or a known beginning and without an assignment is left after one split.

Null and empty texts have no candidates; a null doc_id or path is passed on.
Repeated rows are scanned each by itself. Extra columns are kept by ``redacted``
and ignored by ``findings``.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 16
TREES, DEPTH, LEAF = 24, 9, 4
THRESHOLD = 0.5
MASK = "[SECRET]"

NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)"
ASSIGNED = re.compile(rf"(?i)(?<![\w.\-])[\w.\-]*?{NAMES}\w{{0,16}}[\"']?\s*(?:=>|:=|[:=])\s*(?:bearer\s+)?([\"'`]?)([^\s\"'`,;<>()]{{8,}})")
ADDRESS = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]{1,20}://[^\s/:@]*:([^\s/@]{4,})@")
RUN = re.compile(r"[A-Za-z0-9+/_\-.=]{16,}")
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
KNOWN = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ[A-Za-z0-9_-]+\.eyJ|npm_|SG\.)")
KNOWN_RUN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z0-9+/_\-.=]{16})" + KNOWN.pattern[1:] + r"[A-Za-z0-9+/_\-.=]*")
GOOD_NEAR = re.compile(rf"(?i){NAMES}")
BAD_NEAR = re.compile(r"(?i)\b(?:sha(?:1|256|512)?|md5|commit|hash|checksum|digest|uuid|guid|etag|revision|rev|id|order|card|phone|isbn|integrity|example|sample|dummy|placeholder|test|version|build|trace|session)\b")
FALSE_PATH = re.compile(r"(?i)(?:test|fixture|example|sample|mock|vendor|lock|\.min\.)")
HOLDER = re.compile(r"(?i)(?:your|example|sample|dummy|change|placeholder|xxxx|test|foo|bar|insert|here|redacted|none|null|true|false|password|secret|\*\*\*|<|\{)")
WORDS = frozenset("""the and for that with this from are was have not you all can her his one our out day get has him how man new now old see two way who
about after again below could every first found great house large learn never other place plant point right small sound spell still study their there these thing think three water where which world would write
user name data file path code type list item value string number object function class method module package server client config default system service request response error message table column index
key token secret password access admin login account public private example sample test dummy placeholder change your insert here redacted config setting token build version release master main branch commit""".split())
FEATURES = ["length", "entropy", "digits", "upper", "lower", "other", "turns", "pairs", "hex", "decimal", "coverage", "holder", "known", "good_near", "good_last", "bad_near", "assigned", "quoted", "uuid", "path_given", "path_false", "repeats", "block", "address"]
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidate strings in order, none overlapping another."""
    if not text:
        return []
    found = []
    if "-----BEGIN" in text:
        found += [(*m.span(), "block") for m in BLOCK.finditer(text)]
    if "://" in text:
        found += [(*m.span(1), "address") for m in ADDRESS.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(2), "assigned") for m in ASSIGNED.finditer(text)]
    long = [w for w in text.split() if len(w) >= SHORTEST]
    if any(map(KNOWN_RUN.search, long)):
        found += [(*m.span(), "run") for m in KNOWN_RUN.finditer(text)]
    if any(map(_digit, long)):
        found += [(*m.span(), "run") for m in RUN.finditer(text) if _digit(m.group())]
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:  # the kind that knows more comes first
        at = bisect.bisect_left(starts, a)
        near = out[max(0, at - 1) : bisect.bisect_left(starts, b)]
        parts, begin = [], a
        for x, y, _ in near:
            if y > a and x < b:
                parts.append((begin, min(b, x)))
                begin = max(begin, y)
        parts.append((begin, b))
        for x, y in parts:
            whole = (x, y) == (a, b)
            if whole or y - x >= SHORTEST and _digit(text, x, y):
                at = bisect.bisect_left(starts, x)
                starts.insert(at, x)
                out.insert(at, (x, y, kind if whole else "run"))
    return out


_digit = re.compile(r"\d").search
_RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+")
_WORD = re.compile(r"[a-z]{2,}")


def coverage(word: str) -> float:
    """Share of the letters that lie in dictionary words of three letters or more."""
    low, covered, i = word.lower(), 0, 0
    while i < len(low):
        for k in range(min(11, len(low) - i), 2, -1):
            if low[i : i + k] in WORDS:
                covered += k
                i += k
                break
        else:
            i += 1
    return covered / max(1, sum(c.isalpha() for c in low))


def transitions(texts: Iterable[str]) -> dict[str, float]:
    """log2-probabilities of the second letter of a pair given the first, from
    the words of texts; a pair that they don't hold is absent."""
    pairs = Counter(w[k : k + 2] for t in texts for w in _WORD.findall(t) for k in range(len(w) - 1))
    first = Counter()
    for p, n in pairs.items():
        first[p[0]] += n
    return {p: math.log2((n + 0.5) / (first[p[0]] + 13)) for p, n in pairs.items()}


#: Of a pair of characters that no word holds.
RARE_PAIR = -9.0


def vector(text: str, start: int, end: int, kind: str, path: str | None = None, pairs: dict[str, float] | None = None) -> list[float]:
    """The features of one whole candidate, in the order of FEATURES."""
    w = text[start:end]
    n = len(w)
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    counts = Counter(w)
    share = Counter()
    for c, k in counts.items():
        share["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o"] += k
    low = w.lower()
    line = before.rpartition("\n")[2]
    last = " ".join(line.split()[-2:])
    score = (pairs or {}).get
    return [
        min(n, 200), -sum(c / n * math.log2(c / n) for c in counts.values()), share["d"] / n, share["u"] / n, share["l"] / n, share["o"] / n, (len(_RUNS.findall(w)) - 1) / n,
        sum(k * score(p, RARE_PAIR) for p, k in Counter(map("".join, zip(low, low[1:], strict=False))).items()) / max(1, n - 1),
        float(set(counts) <= _HEX), float(w.isdigit()), coverage(w), float(bool(HOLDER.search(w))), float(bool(KNOWN.match(w))),
        float(bool(GOOD_NEAR.search(line))), float(bool(GOOD_NEAR.search(last))), float(bool(BAD_NEAR.search(last + " " + after.partition("\n")[0][:12]))),
        float(kind == "assigned"), float(before[-1:] in ("'", '"', "`") and before != ""), float(bool(_UUID.fullmatch(w))),
        float(path is not None), float(bool(path and FALSE_PATH.search(path))), max(counts.values()) / n, float(kind == "block"), float(kind == "address"),
    ]


_HEX = frozenset(string.hexdigits)


def labelled_findings(n: int = 2500, seed: int = 11) -> list[tuple[str, int, int, str, int, str | None]]:
    """(text, start, end, kind, label, path) drawn by a seeded generator: n
    secrets and n false alarms. Half have a path; secrets mostly one of sources
    and settings, false alarms mostly one of tests, examples or vendored files."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = "the er on an re he in ed nd ha at en es of or nt ti st ar ción que eau ung sch lich keit mente".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    plain = lambda k: " ".join(word() for _ in range(k))
    case = lambda s: s.upper() if r.random() < 0.15 else s
    name = lambda: r.choice(["", "", "", "db_", "app.", "my-", "AWS_"]) + r.choice(["token", "secret", "password", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "passwd", "db_password", "private_key"])
    kept_in = lambda: r.choice(["src/", "app/", "deploy/", "", "infra/prod/"]) + word() + r.choice([".py", ".env", ".yaml", ".tf", ".ini", ".js", ".sh"])
    false_in = lambda: r.choice(["tests/", "test/fixtures/", "examples/", "vendor/", "docs/samples/", "mocks/"]) + word() + r.choice([".py", ".json", ".lock", ".min.js", ".md"])
    true = [
        lambda: f'{name()} = "{pick(hexa, r.choice([32, 40, 40, 40, 64]))}"',
        lambda: f"{name()}={pick(alnum, r.randint(16, 64))}",
        lambda: f"{name()}: '{pick(alnum + '+/', r.randint(20, 400))}'",
        lambda: f"{name()} {pick(hexa, r.choice([32, 40, 64]))}",
        lambda: f"Authorization: Bearer {pick(alnum + '-_', r.randint(24, 80))}",
        lambda: r.choice(["", "key ", "use "]) + "AKIA" + pick(string.ascii_uppercase + "234567", 16),
        lambda: r.choice(["", "key "]) + r.choice(["ghp_", "sk-", "glpat-", "sk_live_", "xoxb-", "npm_", "AIza"]) + pick(alnum, r.choice([24, 36, 40])),
        lambda: f'{name()} = "{pick(alnum + "!@#$%^&*", r.randint(10, 24))}"',
        lambda: f"{name()}={pick(alnum, r.randint(4, 12))}{pick('!@#$%^&*', r.randint(1, 3))}{pick(alnum, r.randint(3, 8))}",
        lambda: f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum + '-_', 43)}",
        lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{pick(alnum + '+/', 120)}\n-----END RSA PRIVATE KEY-----",
        lambda: f"{r.choice(['postgres', 'mysql', 'redis', 'https', 'amqp'])}://{word()}:{pick(alnum + '!$%', r.randint(8, 20))}@{word()}.{r.choice(['com', 'net', 'local'])}/{word()}",
    ]
    false = [
        lambda: f"{r.choice(['commit', 'sha1', 'hash', 'checksum:', 'md5', 'sha256:', 'digest', 'etag', 'revision'])} {pick(hexa, r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(['id', 'uuid', 'guid', 'trace', 'session', ''])} {pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-a{pick(hexa, 3)}-{pick(hexa, 12)}",
        lambda: f"{plain(1)} {pick(string.digits, r.choice([16, 16, 16, 17, 20]))}",
        lambda: f"{r.choice(['card', 'order', 'isbn', 'phone', 'call'])} {pick(string.digits, 16)}",
        lambda: f'{name()} = "{r.choice(["your_token_here", "changeme123", "example_key_1", "xxxxxxxxxxxxxxxx1", "password123", "test_secret_42", "<your-key-1>", "${SECRET_1}", "dummy_value_0001", "insert_key_here_1"])}"',
        lambda: f"{name()}: {r.choice(['string', 'required', 'get_token(1)', 'config.key_1', 'os.environ[1]', 'None', 'nullable', 'optional_1'])}",
        lambda: f"{name()}: {word()}{word()}{word()} {plain(2)}",
        lambda: f"{r.choice(['data:image/png;base64,', 'integrity sha512-'])}{pick(alnum + '+/', 64)}",
        lambda: f"http://www.{word()}.com/{word()}/{r.randint(1000, 99999)}/{word()}.html",
        lambda: f"http://{word()}:{r.choice(['password', 'pass', 'your_password', 'xxxx', '<password>'])}@{word()}.example.com",
        lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 99)}_{word()}{word()}",
        lambda: f"{word()}{word()}{word()}-{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{word()}",
        lambda: f"{r.randint(1, 99)}.{word()}{r.randint(1, 9)}@mail{r.randint(1, 9)}.example.com",
        lambda: f"{pick(hexa, r.choice([32, 40, 64]))}",
        lambda: f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}/{r.randint(1000, 9999)}/{r.randint(100, 999)}",
    ]
    fixture = lambda: f'{name()} = "{pick(alnum, r.randint(16, 40))}"'  # noqa: E731  only a false alarm where it stands
    false += [fixture] * 2
    near = "session build version test trace id order example".split()
    out: list[tuple[str, int, int, str, int, str | None]] = []
    for label, makers in ((1, true), (0, false)):
        for _ in range(n):
            head, tail = plain(r.randint(0, 6)), plain(r.randint(0, 6))
            if label and r.random() < 0.12:
                head += " " + r.choice(near)
            make = makers[r.randrange(len(makers))]
            text = case(head + (" " if head else "") + make() + r.choice([" ", "\n", ", ", "!! ", "### "]) + tail)
            path = false_in() if make is fixture else None if r.random() < 0.5 else kept_in() if (r.random() < 0.8) == bool(label) else false_in()
            out += [(text, *c, label, path) for c in candidates(text)[:1]]
    return out


class Forest:
    """Trees as flat arrays: feature (-1 at leaves), cut, left child (the
    right one follows), and the share of secrets."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], pairs: dict[str, float]):
        self.trees, self.pairs = trees, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                go = left[at] + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = np.where(inner, go, at)
            total += value[at]
        return total / len(self.trees)


def train(findings: list[tuple[str, int, int, str, int, str | None]], seed: int = 5) -> Forest:
    """A forest from labelled findings: bootstrap rows, a random third of the
    features at each node, cuts at quantiles, Gini impurity. Letter pairs are
    learned from the dictionary and from what stands around the findings."""
    pairs = transitions([*(f[0][: f[1]] + " " + f[0][f[2] :] for f in findings), *sorted(WORDS)])
    x = np.array([vector(*f[:4], f[5], pairs) for f in findings])
    y = np.array([f[4] for f in findings], dtype=float)
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        feature, cut, left, value = [-1], [0.0], [0], [0.5]
        rows = rng.integers(0, len(x), len(x))
        todo = [(0, rows, 0)]
        while todo:
            node, rows, depth = todo.pop()
            t = y[rows]
            value[node] = (t.sum() + 0.5) / (len(t) + 1)
            if depth >= DEPTH or len(t) < 2 * LEAF or t.min() == t.max():
                continue
            best = (1e-9, -1, 0.0)
            own = t.mean() * (1 - t.mean())
            for f in rng.choice(x.shape[1], 8, replace=False):
                v = x[rows, f]
                for c in np.unique(np.quantile(v, (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95))):
                    right = v > c
                    k = int(right.sum())
                    if LEAF <= k <= len(t) - LEAF:
                        a, b = t[right].mean(), t[~right].mean()
                        gain = own - (k * a * (1 - a) + (len(t) - k) * b * (1 - b)) / len(t)
                        best = max(best, (gain, int(f), float(c)))
            if best[1] < 0:
                continue
            right = x[rows, best[1]] > best[2]
            feature[node], cut[node], left[node] = best[1], best[2], len(feature)
            for part in (rows[~right], rows[right]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1), cut.append(0.0), left.append(0), value.append(0.5)
        trees.append((np.array(feature), np.array(cut), np.array(left), np.array(value)))
    return Forest(trees, pairs)


_default: list[Forest] = []


def default_forest() -> Forest:
    if not _default:
        _default.append(train(labelled_findings()))
    return _default[0]


def scan(text: str | None, forest: Forest, path: str | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of a text's candidates."""
    found = candidates(text)
    if not found:
        return []
    scores = forest.score(np.array([vector(text, *c, path, forest.pairs) for c in found]))
    return [(*c, float(s)) for c, s in zip(found, scores, strict=True)]


def findings(docs: DataFrame, forest: Forest | None = None, text: str = "text", path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per candidate: doc_id, start_at and end_at (characters), kind,
    sha256 of the string, score and is_secret."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start_at", "end_at", "kind", "sha256", "score", "is_secret"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
        for batch in batches:
            out = []
            paths = batch.column(2).to_pylist() if path else [None] * batch.num_rows
            for i, t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), paths, strict=True):
                out += [(i, a, b, kind, hashlib.sha256(t[a:b].encode()).hexdigest(), s, s >= threshold) for a, b, kind, s in scan(t, sent.value, p)]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text), *([F.col(path)] if path else []))
    return rows.mapInArrow(run, "doc_id long, start_at int, end_at int, kind string, sha256 string, score double, is_secret boolean")


def redacted(docs: DataFrame, forest: Forest | None = None, text: str = "text", threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """docs with each secret of a text replaced by MASK."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def clean(t: str | None, where: str | None) -> str | None:
        parts, end = [], 0
        for a, b, _, s in scan(t, sent.value, where):
            if s >= threshold:
                parts += [t[end:a], MASK]
                end = b
        return "".join([*parts, t[end:]]) if parts else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            paths = batch.column(batch.schema.get_field_index(path)).to_pylist() if path else [None] * batch.num_rows
            columns[at] = pa.array([clean(t, p) for t, p in zip(columns[at].to_pylist(), paths, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
