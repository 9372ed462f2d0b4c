"""Toxicity of whole texts by a linear-chain conditional random field.

Tokens are runs of letters and digits, lower-cased (A-Z). Labels mark whole
documents, so tokens are labelled from them: words and word beginnings (4 to 6
characters) that occur in far more toxic than clean documents mark a token of a
toxic document as toxic, all other tokens are clean. On these labelled tokens a
two-state chain is fitted by gradient ascent on the conditional likelihood:
emission weights of the token's word, its beginnings and a bias, and a
transition matrix. Forward-backward marginals of the whole text are aggregated
to a document score by a logistic function of the expected number of toxic
tokens, their share, and the probability of at least one, which is fitted on
labelled documents that neither the lexicon nor the chain has seen.

Training reads at most ``TOXIC`` toxic and ``CLEAN`` clean labelled documents
(those with the smallest hashes of doc_id), whole. Tasks count their features
and cut their windows; only counts of features and of distinct windows are sent
on, no text. The chain that scores is fitted on all of them; the logistic
function on a third of them, scored by a chain fitted on the other two thirds.
Scoring reads every text in one pass without a shuffle.

Between tokens that carry a feature the chain is constant, so its powers are
tabulated, and only tokens with features are visited: exact up to the power
where the chain has converged to double precision.

Null and empty texts have a score like any other (that of a text without
tokens). Labels that are null don't count; rows of labels that disagree count
as toxic. Of several texts with one doc_id training reads the least. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Kept

#: Labelled documents that training reads.
TOXIC, CLEAN = 4000, 6000
#: A feature marks toxic tokens from this log ratio of document shares and
#: this many toxic documents on; the lexicon has at most MOST features.
RATIO, SUPPORT, MOST = 1.5, 4, 20_000
PREFIXES = (4, 5, 6)
CACHE = 300_000
#: Windows that a step of the fit works on at a time.
CHUNK = 16_384
#: Powers of the constant chain that are tabulated.
POWERS = 256

_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings with a mark; cut between characters."""
    if len(word) < PREFIXES[0]:
        return [word]
    w = word.decode()
    return [word, *(f"{w[:k]}*".encode() for k in PREFIXES if len(w) >= k)]


class Chain:
    """The fitted model: weights by feature, and the chain's constants."""

    def __init__(self, weights: dict[bytes, float], bias: float, trans: np.ndarray, doc: np.ndarray):
        self.weights, self.bias, self.trans, self.doc = weights, bias, trans, doc
        self.emission = _Emission(weights)
        step = np.exp(trans) * np.array([1.0, math.exp(bias)])[None, :]
        powers = [np.eye(2)]
        for _ in range(POWERS):
            nxt = powers[-1] @ step
            powers.append(nxt / nxt.sum())
        self.powers = [tuple(map(float, p.ravel())) for p in powers]

    def __reduce__(self):
        return Chain, (self.weights, self.bias, self.trans, self.doc)

    def marginals(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        """Places of the tokens with features and their probability of being toxic."""
        found = list(map(self.emission.__getitem__, words))
        at = [i for i, e in enumerate(found) if e]
        if not at:
            return [], []
        powers, last = self.powers, len(self.powers) - 1
        boost = [math.exp(min(found[i], 50.0)) for i in at]
        # forward: before each visited token the constant chain, then its own weight
        f, forward, before = (1.0, 0.0), [], -1
        for i, b in zip(at, boost, strict=True):
            p = powers[min(i - before, last)]
            x, y = f[0] * p[0] + f[1] * p[2], (f[0] * p[1] + f[1] * p[3]) * b
            f = x / (x + y), y / (x + y)
            forward.append(f)
            before = i
        out, g, after = [0.0] * len(at), (1.0, 1.0), len(words) - 1
        for k in range(len(at) - 1, -1, -1):
            p = powers[min(after - at[k], last)]
            h = p[0] * g[0] + p[1] * g[1], p[2] * g[0] + p[3] * g[1]
            a, b = forward[k][0] * h[0], forward[k][1] * h[1]
            out[k] = b / (a + b)
            s = h[0] + h[1]
            g, after = (h[0] / s, boost[k] * h[1] / s), at[k]
        return at, out

    def aggregate(self, words: list[bytes]) -> list[float]:
        _, m = self.marginals(words)
        expected = sum(m)
        none = math.exp(sum(math.log1p(-min(x, 1 - 1e-9)) for x in m))
        return [1.0, math.log1p(expected), min(1.0, 50.0 * expected / (len(words) + 20.0)), 1.0 - none, math.log1p(len(words)) / 10.0]

    def score(self, words: list[bytes]) -> float:
        z = float(np.dot(self.doc, self.aggregate(words)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of toxic tokens, in characters."""
        words = tokens(text)
        at, m = self.marginals(words)
        toxic = {i: p for i, p in zip(at, m, strict=True) if p >= least}
        if not toxic:
            return []
        places = [x.span() for x in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]
        return [(*places[i], p) for i, p in toxic.items()]


class _Emission(dict):
    """The summed weight of a word's features, 0 for words without any."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        total = sum([self.weights.get(f, 0.0) for f in features(word)])
        if len(word) <= 64:
            self[word] = total
        return total


def weight(toxic, clean, n_toxic, n_clean, log=math.log, root=math.sqrt):
    """log ratio of a feature's document shares, and its rank in the lexicon."""
    ratio = log((toxic + 0.5) / (n_toxic + 1)) - log((clean + 0.5) / (n_clean + 1))
    return ratio, ratio * root(toxic)


def lexicon(docs: list[tuple[list[bytes], int]]) -> list[bytes]:
    """Features that occur in far more toxic than clean documents."""
    seen, n = (Counter(), Counter()), [0, 0]
    for words, toxic in docs:
        n[toxic] += 1
        seen[toxic].update({f for w in set(words) for f in features(w)})
    found = []
    for f, k in seen[1].items():
        ratio, rank = weight(k, seen[0][f], n[1], n[0])
        if k >= SUPPORT and ratio >= RATIO and k * max(n[0], 1) >= 3 * n[1] * seen[0][f]:
            found.append((rank, f))
    return [f for _, f in sorted(found, reverse=True)[:MOST]]


class _Windows:
    """Token windows of one length with the number of times that each occurs:
    labels, and the features by their places."""

    def __init__(self, windows: list[tuple[list[list[int]], list[int], int]]):
        self.y = np.array([t for _, t, _ in windows])
        self.times = np.array([n for *_, n in windows], dtype=float)
        rows = np.array([(k, j) for k, (p, *_) in enumerate(windows) for j, x in enumerate(p) for _ in x], dtype=int).reshape(-1, 2)
        self.cols = np.array([i for p, *_ in windows for x in p for i in x], dtype=int)
        self.flat = rows[:, 0] * self.y.shape[1] + rows[:, 1]

    def gradient(self, weights: np.ndarray, bias: float, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Of the log-likelihood, for weights, bias and transitions."""
        n = self.y.shape
        e = bias + np.bincount(self.flat, weights=weights[self.cols], minlength=n[0] * n[1]).reshape(n)
        psi, emit = np.exp(trans), np.exp(np.clip(e, -30, 30))
        alpha, beta = np.empty((*n, 2)), np.ones((*n, 2))
        for j in range(n[1]):
            a = np.ones((n[0], 2)) if j == 0 else alpha[:, j - 1] @ psi
            a[:, 1] *= emit[:, j]
            alpha[:, j] = a / a.sum(1, keepdims=True)
        pair = np.zeros((2, 2))
        for j in range(n[1] - 1, 0, -1):
            b = beta[:, j].copy()
            b[:, 1] *= emit[:, j]
            joint = alpha[:, j - 1, :, None] * psi[None] * b[:, None, :]
            pair += (joint * (self.times / joint.sum((1, 2)))[:, None, None]).sum(0)
            b = b @ psi.T
            beta[:, j - 1] = b / b.sum(1, keepdims=True)
        post = alpha * beta
        post = post[..., 1] / post.sum(-1)
        real = np.zeros((2, 2))
        np.add.at(real, (self.y[:, :-1].ravel(), self.y[:, 1:].ravel()), np.repeat(self.times, n[1] - 1))
        diff = (self.y - post) * self.times[:, None]
        return np.bincount(self.cols, weights=diff.ravel()[self.flat], minlength=len(weights)), diff.sum(), real - pair


def windows_of(words: list[bytes], toxic: int, index: dict[bytes, int], width: int = 9) -> list[tuple[list[list[int]], list[int]]]:
    """A window around every token that carries a feature, or around the middle
    of a document without any; a shorter document is one window."""
    has = [[index[f] for f in features(w) if f in index] for w in words]
    if not has:
        return []
    at = [i for i, x in enumerate(has) if x] or [len(words) // 2]
    parts = [has[low : low + width] for low in sorted({max(0, min(i - width // 2, len(words) - width)) for i in at})]
    return [(part, [int(bool(x) and toxic) for x in part]) for part in parts]


def packed(window: tuple[list[list[int]], list[int]]) -> bytes:
    """A window as text: the features of each token, and a mark at toxic ones."""
    return ";".join(",".join(map(str, x)) + "!" * t for x, t in zip(*window, strict=True)).encode()


def unpacked(window: bytes) -> tuple[list[list[int]], list[int]]:
    places = window.decode().split(";")
    return [[int(i) for i in p.rstrip("!").split(",") if i] for p in places], [int(p.endswith("!")) for p in places]


def fit_windows(found: Iterable[tuple[bytes, int]], n: int, epochs: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of n features, bias and transitions from (packed window, times)."""
    by_length: dict[int, list] = {}
    for window, times in found:
        p, y = unpacked(window)
        by_length.setdefault(len(p), []).append((p, y, times))
    weights, bias, trans = np.zeros(n), -2.0, np.zeros((2, 2))
    groups = [_Windows(by_length[k][at : at + CHUNK]) for k in sorted(by_length) for at in range(0, len(by_length[k]), CHUNK)]
    if not groups:
        return weights, bias, trans
    size = sum(g.times.sum() for g in groups)
    m_w, v_w, small, v_small = np.zeros(n), np.zeros(n), np.zeros(5), np.zeros(5)
    for t in range(1, epochs + 1):
        g_w, g_b, g_t = np.zeros(n), 0.0, np.zeros((2, 2))
        for g in groups:
            a, b, c = g.gradient(weights, bias, trans)
            g_w, g_b, g_t = g_w + a, g_b + b, g_t + c
        g_w = g_w - 0.05 * weights
        g_s = np.array([g_b - 0.1 * bias, *g_t.ravel() - 0.1 * trans.ravel()]) / size
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.99 * v_w + 0.01 * g_w**2
        small, v_small = 0.9 * small + 0.1 * g_s, 0.99 * v_small + 0.01 * g_s**2
        c = 0.3 / (1 - 0.9**t)
        weights += c * m_w / (np.sqrt(v_w / (1 - 0.99**t)) + 1e-8)
        move = c * small / (np.sqrt(v_small / (1 - 0.99**t)) + 1e-8)
        bias, trans = bias + move[0], trans + move[1:].reshape(2, 2)
    return weights, float(bias), trans


def fit_chain(docs: list[tuple[list[bytes], int]], epochs: int = 60) -> tuple[dict[bytes, float], float, np.ndarray]:
    """Weights, bias and transitions from tokens labelled by their documents.
    Of each document all windows of tokens that carry a feature are used; plain
    tokens count as far as they lie in such a window."""
    names = lexicon(docs)
    index = {f: i for i, f in enumerate(names)}
    found = Counter(packed(w) for words, toxic in docs for w in windows_of(words, toxic, index))
    weights, bias, trans = fit_windows(sorted(found.items()), len(names), epochs)
    return dict(zip(names, weights.tolist(), strict=True)), bias, trans


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        move = np.linalg.solve(hess, x.T @ (y - p) - 0.1 * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, text: str) -> Kept:
    """(doc_id, toxic, rest, text) of the labelled documents that training
    reads; a third of them, for the document score, has rest = 1."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for toxic, most in ((1, TOXIC), (0, CLEAN)):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rest = (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0).cast("int").alias("rest")
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return Kept(rows.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text")).select("doc_id", "toxic", rest, "text"))


def _counted(rows: DataFrame, keys: Callable, schema: str) -> DataFrame:
    """Counts of what keys(toxic, rest, text) yields; added up in each task first."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            columns = [*zip(*counts, strict=True), tuple(counts.values())]
            counts.clear()
            return pa.RecordBatch.from_pydict(dict(zip([*names, "times"], columns, strict=True)), schema=kinds)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("toxic", "rest", "text")), strict=True):
                counts.update(keys(*(x.as_py() for x in row)))
                if len(counts) > CACHE:
                    yield sent()
        if counts:
            yield sent()

    full = f"{schema}, times long"
    kinds = to_arrow_schema(T._parse_datatype_string(full))
    return rows.select("toxic", "rest", "text").mapInArrow(run, full).groupBy(*names).agg(F.sum("times").alias("times"))


def _lexica(rows: DataFrame) -> list[list[bytes]]:
    """The lexicon of all rows and that of those with rest = 0, of MOST features
    at most, found by counts of documents."""

    def keys(toxic: int, rest: int, text: str | None) -> Iterator[tuple]:
        yield b"", toxic, rest  # counts the documents
        yield from {(f, toxic, rest) for w in set(tokens(text)) for f in features(w)}

    counts = Kept(_counted(rows, keys, "feature binary, toxic int, rest int"))
    n = {(r.toxic, r.rest): r.times for r in counts.df.where("feature = X''").collect()}
    out = []
    for own in ((0, 1), (0,)):
        toxic, clean = (sum(n.get((y, k), 0) for k in own) for y in (1, 0))
        part = lambda y, own=own: F.coalesce(F.sum(F.when((F.col("toxic") == y) & F.col("rest").isin(*own), F.col("times"))), F.lit(0))
        by = counts.df.where("feature <> X''").groupBy("feature").agg(part(1).alias("k"), part(0).alias("c"))
        ratio, rank = weight(F.col("k"), F.col("c"), toxic, clean, F.log, F.sqrt)
        by = by.where((F.col("k") >= SUPPORT) & (ratio >= RATIO) & (F.col("k") * max(clean, 1) >= 3 * toxic * F.col("c")))
        out.append([bytes(r.feature) for r in by.orderBy(rank.desc(), F.col("feature").desc()).limit(MOST).collect()])
    counts.drop()
    return out


def _chains(rows: DataFrame, lexica: list[list[bytes]]) -> list[Chain]:
    """A chain for each lexicon; the second is fitted on rows with rest = 0."""
    sent = rows.sparkSession.sparkContext.broadcast([{f: i for i, f in enumerate(names)} for names in lexica])

    def keys(toxic: int, rest: int, text: str | None) -> Iterator[tuple]:
        words = tokens(text)
        for k, index in enumerate(sent.value):
            if not (k and rest):
                yield from ((k, packed(w)) for w in windows_of(words, toxic, index))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for k, window, times in zip(*(batch.column(c).to_pylist() for c in ("k", "window", "times")), strict=True):
                found.setdefault(k, []).append((window, times))
        for k, own in found.items():
            fitted = fit_windows(sorted(own), len(sent.value[k]))
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "fitted": pa.array([pickle.dumps(fitted)], pa.binary())})

    windows = _counted(rows, keys, "k int, window binary").repartitionById(len(lexica), F.col("k"))
    fitted = {r.k: pickle.loads(r.fitted) for r in windows.mapInArrow(fit, "k int, fitted binary").collect()}
    none = lambda names: (np.zeros(len(names)), -2.0, np.zeros((2, 2)))
    out = []
    for k, names in enumerate(lexica):
        weights, bias, trans = fitted.get(k) or none(names)
        out.append(Chain(dict(zip(names, weights.tolist(), strict=True)), bias, trans, np.zeros(5)))
    return out


def trained_model(docs: DataFrame, labels: DataFrame, text: str = "text") -> Chain:
    """The model, fitted on the bounded sample."""
    sample = _sample(docs, labels, text)
    whole, part = _chains(sample.df, _lexica(sample.df))
    sent = sample.df.sparkSession.sparkContext.broadcast(pickle.dumps(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = pickle.loads(sent.value)
        for batch in batches:
            x = [chain.aggregate(tokens(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    seen = sorted((r.toxic, r.x) for r in sample.df.where("rest = 1").select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect())
    sample.drop()
    if any(y for y, _ in seen):
        doc = fit_logistic(np.array([x for _, x in seen]), np.array([y for y, _ in seen], dtype=float))
    else:
        doc = np.array([-3.0, 1.0, 1.0, 1.0, 0.0])
    return Chain(whole.weights, whole.bias, whole.trans, doc)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; with
    ``spans`` also the offending places (start, end, probability)."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(trained_model(docs, labels, text)))
    loaded: dict[int, Chain] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = loaded.get(0) or loaded.setdefault(0, pickle.loads(sent.value))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            score = np.array([chain.score(tokens(t)) for t in texts], dtype=float)
            columns, names = [*batch.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            if spans:
                columns.append(pa.array([[dict(zip(("start", "end", "probability"), s, strict=True)) for s in chain.spans(t or "")] for t in texts], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, held_out boolean, score double, predicted int" + ", spans array<struct<start:int,end:int,probability:double>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col(text)).mapInArrow(run, schema)
