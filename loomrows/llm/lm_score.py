"""Scores of whole texts by a gated recurrent language model.

Tokens are lower-cased words (A-Z) and one end per text. Texts whose
crc32(doc_id) mod 10 is not 0 are learned from.

1. Counts of all training tokens: each task counts its texts, partial counts
   are added up by a shuffle. Base scores and the model's word probabilities
   inside the rest classes come from these counts over the whole corpus.
2. Vocabulary: the ``SHORT`` most frequent tokens are dealt by frequency to
   ``CLASSES`` classes; all others fall in ``REST`` rest classes by their form
   (ASCII or not; last character a letter, digit, stop, comma or other).
3. Coding: each text becomes its row of inputs, two bytes a token, with the sums
   that need counts alone. Counts of the ``FREQUENT`` most frequent tokens are
   broadcast; rarer tokens are joined with the counts and added to their texts.
4. Network: a gated recurrent unit of ``HIDDEN`` cells. Its output is factored:
   a softmax over classes, then one over the words of the class; in a rest
   class the absolutely discounted count of the word, where the discount is the
   probability of a word that training never saw. It is trained in numpy by
   truncated backpropagation on all training texts: they are dealt by a hash to
   up to ``ROUNDS`` rounds and, in a round, to shards of about ``SHARD`` tokens.
   Each shard trains on from the parameters of the round before, and the
   parameters of its shards, weighted by tokens, are averaged piece by piece.
5. Scoring: texts of like length advance together, window by window, and the
   state is carried on, so a score is the log-likelihood of the complete text.
   Memory is that of a window, however long a text is.

The unit of prediction is the same as in the base score: a training token, or a
token that training never saw. Null and empty texts are the end token alone. A
null doc_id is learned from. Repeated rows are scored each by itself. Without
training texts every probability is that of the smoothing alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept

SHORT, CLASSES, HIDDEN = 2000, 24, 32
#: Tokens whose counts are broadcast.
FREQUENT = 200_000
LANES, STEPS, RATE = 512, 16, 0.006
#: Rounds of training, tokens of a shard, and pieces of the averaged parameters.
ROUNDS, SHARD, PIECES = 4, 1 << 20, 16
#: Steps of gradient descent; a small corpus is gone through more often.
LEAST_UPDATES = 400
#: Tokens of a text and texts that are scored at a time, and rows whose words
#: are split at a time.
WINDOW, GROUP, SLICE = 32, 512, 2048
#: Tokens that are counted at a time.
TALLY = 3 << 20
END = ""
KINDS = 5
REST = 2 * KINDS


def words(text: str | None) -> list[bytes]:
    """The words of one text."""
    return (text or "").encode().lower().split()


def words_of_all(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts one after another, and where each text's words begin
    (with the end of the last)."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # a text without words would give an empty one
    some = np.asarray(pc.greater(pc.binary_length(trimmed), 0).cast(pa.int8())).astype(bool)
    lists = pc.ascii_split_whitespace(trimmed.filter(pa.array(some)))
    sizes = np.zeros(len(texts), np.int64)
    sizes[some] = np.diff(np.asarray(lists.offsets))
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten()


def rest_class(word: bytes) -> int:
    """The class of a word outside the short list, by its form."""
    last = word[-1]
    kind = 0 if 97 <= last < 123 or last >= 128 else 1 if 48 <= last < 58 else 2 if last == 46 else 3 if last == 44 else 4
    return kind + KINDS * (not word.isascii())


def rest_classes(words: pa.Array) -> np.ndarray:
    """The same for many words at once."""
    if not len(words):
        return np.zeros(0, np.int32)
    raw = words.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[: ends[-1]]
    last = data[ends[1:] - 1]
    kind = np.select([(97 <= last) & (last < 123) | (last >= 128), (48 <= last) & (last < 58), last == 46, last == 44], [0, 1, 2, 3], 4)
    return (kind + KINDS * (np.maximum.reduceat(data, ends[:-1]) >= 128)).astype(np.int32)


def rest_class_of(word: Column) -> Column:
    """The same in Spark."""
    last = F.substring(word, -1, 1)
    kind = F.when(last.rlike("[a-z]") | (F.octet_length(last) > 1), 0).when(last.rlike("[0-9]"), 1).when(last == ".", 2).when(last == ",", 3).otherwise(4)
    return (kind + KINDS * (F.octet_length(word) > F.char_length(word)).cast("int")).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def token_counts(training: DataFrame) -> DataFrame:
    """(word, cls, c) over all training texts (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def sent() -> pa.RecordBatch:
            found = pa.chunked_array(parts).value_counts()
            parts.clear()
            return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "c"])

        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                parts.append(words_of_all(whole.column(0).slice(start, SLICE))[1])
                size += len(parts[-1])
                if size >= TALLY:
                    yield sent()
                    size = 0
        if size:
            yield sent()

    counts = training.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return counts.select("word", rest_class_of(F.col("word")).alias("cls"), "c")


def frequent_tokens(counts: DataFrame, most: int) -> list[tuple[str, int, int]]:
    """About ``most`` of the most frequent (word, c, cls), in order. A short
    histogram of counts finds where to cut, so that no task sends more rows
    than are wanted; of the words at the cut a hashed share is taken."""
    level = F.floor(F.log2("c") * 64).cast("int")
    share, cut, left = 0.0, None, most
    for r in sorted(counts.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        share, cut = min(1.0, left / r.k), r.b
        left -= r.k
        if left <= 0:
            break
    if cut is None:
        return []
    own = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    found = counts.where((level > cut) | ((level == cut) & own)).select("word", "c", "cls").collect()
    return sorted(map(tuple, found), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Short-list words with class and place in it, and constants of the rest."""

    def __init__(self, top: list[tuple[str, int]], n_docs: int, rest: dict[int, tuple[float, float]], n: int, v: int):
        self.n, self.v = n, v
        short = sorted([(c, w) for w, c in top[: SHORT - 1]] + [(n_docs, END)], key=lambda x: (-x[0], x[1]))
        total, upto = sum(c for c, _ in short) or 1, 0
        self.cls, self.place, self.sizes = [], [], [0] * CLASSES
        for c, _ in short:
            k = min(CLASSES - 1, int(CLASSES * upto / total))
            self.cls.append(k)
            self.place.append(self.sizes[k])
            self.sizes[k] += 1
            upto += c
        self.index = {w.encode(): i for i, (_, w) in enumerate(short)}
        self.end = self.index[END.encode()]
        self.cls, self.place = np.array(self.cls), np.array(self.place)
        self.counts = np.array([c for c, _ in short], dtype=float)
        self.rest = rest  # class: (discount, total)

    def base(self, c):
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def inside(self, c: int, cls: int) -> float:
        """log10 of a rest word's probability inside its class."""
        d, total, kinds = self.rest.get(cls, (0.5, 0.0, 0.0))
        if total <= 0:
            return 0.0
        return float(np.log10((c - d) / total if c else d * kinds / total))


def _exp(h: np.ndarray, weights: np.ndarray, top: float, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits h @ weights, less what keeps them from overflow, at (rows, at);
    their exponentials; and the sums of these. States are within -1 and 1, so
    ``top``, the greatest sum of weights, mostly bounds logits without a look
    at each."""
    a = h @ weights
    if top > 40:
        a -= a.max(1, keepdims=True)
    own = a[rows, at]
    np.exp(a, out=a)
    return own, a, a @ np.ones(a.shape[1], a.dtype)


def _sums(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of at in order, and the sum of the rows that have each."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    at, rows = at[order], rows[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    size = np.diff(first, append=len(at))
    out, ones = rows[first], np.ones(len(at), rows.dtype)
    # long runs one by one, the k-th rows of all others at once
    for i in np.flatnonzero(size > 16):
        out[i] = ones[: size[i]] @ rows[first[i] : first[i] + size[i]]
    k, more = 1, np.flatnonzero((size > 1) & (size <= 16))
    while len(more):
        out[more] += rows[first[more] + k]
        k += 1
        more = more[size[more] > k]
    return at[first], out


class Network:
    """Parameters by name, views of one flat array. Inputs are short-list words,
    or a rest class."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 3):
        r = np.random.default_rng(seed)
        h, inputs, outs = HIDDEN, SHORT + REST, CLASSES + REST
        f = lambda *s, k=0.1: r.standard_normal(s) * k
        first = {"E": f(inputs, 3 * h), "U": f(h, 3 * h, k=h**-0.5), "b": np.zeros(3 * h), "C": f(h, outs), "c": np.zeros(outs), "W": f(SHORT, h), "w": np.zeros(SHORT)}
        self.shapes = {name: a.shape for name, a in first.items()}
        self.load(np.concatenate([a.ravel() for a in first.values()]))
        v = vocabulary
        weight = np.zeros(outs)
        np.add.at(weight, v.cls, v.counts)
        for k, (_, total, _) in v.rest.items():
            weight[CLASSES + k] = total
        self.p["c"][:] = np.log(np.maximum(weight, 0.5) / max(weight.sum(), 1))
        self.p["w"][: len(v.counts)] = np.log(np.maximum(v.counts, 0.5))
        # classes are dealt by frequency, so a class is a range of the short list
        self.cuts = np.searchsorted(v.cls, np.arange(CLASSES + 1))
        self.members = [np.arange(*self.cuts[k : k + 2]) for k in range(CLASSES)]

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, upto = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[upto : upto + size].reshape(shape)
            upto += size
        return out

    def flat(self) -> np.ndarray:
        """All parameters in one row."""
        return self.row

    def load(self, flat: np.ndarray) -> None:
        self.row = flat.astype(np.float32)
        self.p = self.views(self.row)

    def __getstate__(self) -> dict:
        return {"row": self.row, "shapes": self.shapes, "cuts": self.cuts, "members": self.members}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.p = self.views(self.row)

    def table(self) -> np.ndarray:
        """The inputs' rows of E with the bias, by gate: each step reads whole
        rows. Both gates are negated, as their exponentials take them."""
        out = np.ascontiguousarray((self.p["E"] + self.p["b"]).reshape(-1, 3, HIDDEN).transpose(1, 0, 2))
        np.negative(out[:2], out=out[:2])
        return out

    def gates(self) -> np.ndarray:
        """U in the same form."""
        out = self.p["U"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2).copy()
        np.negative(out[:2], out=out[:2])
        return out

    def step(self, h: np.ndarray, x: np.ndarray, u: np.ndarray | None = None, into: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """One step from states h and input rows x of E (or of table, with u of
        gates): the new states, both gates, the candidate and its part of h @ U.
        ``into``: where they go."""
        if u is None:
            u, x = self.gates(), x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2) * np.array([-1, -1, 1], x.dtype)[:, None, None]
        new, zr, n, un = into or (np.empty(shape, np.result_type(h, u)) for shape in (h.shape, (2, *h.shape), h.shape, h.shape))
        np.matmul(h, u[:2], out=zr)
        zr += x[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.matmul(h, u[2], out=un)
        np.multiply(zr[1], un, out=n)
        n += x[2]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= zr[0]
        new += n
        return new, zr, n, un

    def outputs(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log p of the classes and, inside the short list, of the words; with
        grads also the gradient for h (of the mean negative log-likelihood)."""
        p, n, k = self.p, len(h), HIDDEN
        # by class, so that each is one slice
        order = np.argsort(cls.astype(np.int8), kind="stable")
        cs, ws = cls[order], word[order]
        # a last state of 1 takes the biases with the weights
        hs = np.empty((n, k + 1), h.dtype)
        h.take(order, axis=0, out=hs[:, :k])
        hs[:, k] = 1
        outer, inner = np.vstack([p["C"], p["c"]]), np.column_stack([p["W"], p["w"]])
        tops = np.abs(inner).sum(1)
        every = np.arange(n)
        own, a, s = _exp(hs, outer, float(np.abs(outer).sum(0).max()), every, cs)
        logp = own - np.log(s)
        dh = None
        if grads is not None:
            a *= (1 / (n * s))[:, None]
            a[every, cs] -= 1 / n
            found, inside = hs.T @ a, np.zeros_like(inner)
            grads["C"] += found[:k]
            grads["c"] += found[k]
            dh = a @ p["C"].T
        cuts = np.searchsorted(cs, np.arange(CLASSES + 1))
        for i in range(CLASSES):
            low, high, first, last = cuts[i], cuts[i + 1], self.cuts[i], self.cuts[i + 1]
            if high > low and last - first > 1:
                hk, at = hs[low:high], ws[low:high] - first
                mine = every[: high - low]
                own, a, s = _exp(hk, inner[first:last].T, float(tops[first:last].max()), mine, at)
                logp[low:high] += own - np.log(s)
                if grads is not None:
                    a *= (1 / (n * s))[:, None]
                    a[mine, at] -= 1 / n
                    np.matmul(a.T, hk, out=inside[first:last])
                    dh[low:high] += a @ p["W"][first:last]
        back = np.empty_like(order)
        back[order] = every
        if grads is None:
            return logp[back], None
        grads["W"] += inside[:, :k]
        grads["w"] += inside[:, k]
        return logp[back], dh[back]

    def train(self, tokens: np.ndarray, cls: np.ndarray, end: int, start: float = 0.0, stop: float = 1.0) -> None:
        """Truncated backpropagation over the tokens of texts one after another,
        each predicted once an epoch; ``start`` and ``stop`` are the shares of
        the whole training that lie before and up to the end of this call."""
        if not len(tokens):
            return
        p, k, t, row = self.p, HIDDEN, 0, self.row
        grad, m, v, room = (np.zeros_like(row) for _ in range(4))
        g = self.views(grad)
        lanes = max(1, min(LANES, len(tokens) // (4 * STEPS)))
        length = -(-len(tokens) // lanes)
        # the last lane is filled up; what fills it is not predicted
        fill = lanes * length - len(tokens)
        x_all = np.concatenate([[end], tokens[:-1], np.full(fill, end)]).astype(np.int32).reshape(lanes, length).T.copy()
        y_all, c_all = (np.concatenate([a, np.full(fill, -1)]).astype(np.int32).reshape(lanes, length).T.copy() for a in (tokens, cls))
        each = -(-length // STEPS)
        epochs = max(1, -(-int(LEAST_UPDATES * (stop - start)) // each))
        updates = epochs * each
        # by step and lane: states (before each step, and after the last), both
        # gates, the candidate, its part of h @ U, and three of gradients
        room_of = lambda *shape: np.empty((*shape, lanes, k), np.float32)
        whole = room_of(STEPS + 1), room_of(2, STEPS), room_of(STEPS), room_of(STEPS), room_of(3, STEPS), room_of(STEPS), room_of(STEPS)
        through, sent = room_of(3), np.empty((STEPS * lanes, 3, k), np.float32)
        for _ in range(epochs):
            h = np.zeros((lanes, k), np.float32)
            for begin in range(0, length, STEPS):
                x = x_all[begin : begin + STEPS]
                y, yc = y_all[begin : begin + STEPS].ravel(), c_all[begin : begin + STEPS].ravel()
                grad[:] = 0
                steps = len(x)
                rows, u = self.table().take(x, axis=1), self.gates()
                states, zr, n, un, by, by_n, off = (a[..., : steps + (a is whole[0]), :, :] for a in whole)
                states[0] = h
                for j in range(steps):
                    self.step(states[j], rows[:, j], u, (states[j + 1], zr[:, j], n[j], un[j]))
                h = states[steps].copy()
                flat = states[1:].reshape(-1, k)
                real = y >= 0
                if real.all():
                    _, dflat = self.outputs(flat, yc, y, g)
                else:
                    dflat = np.zeros_like(flat)
                    if real.any():
                        dflat[real] = self.outputs(flat[real], yc[real], y[real], g)[1]
                (z, r), prev = zr, states[:-1]
                # what the gradient of a state is multiplied by, for all steps
                # at once: for both gates and the candidate's part of h @ U, and
                # for the candidate
                np.subtract(1, z, out=off)
                np.multiply(n, n, out=by_n)
                np.subtract(1, by_n, out=by_n)
                by_n *= off
                off *= z
                np.subtract(prev, n, out=by[0])
                by[0] *= off
                np.multiply(by_n, r, out=by[2])
                np.multiply(un, by[2], out=by[1])
                np.subtract(1, r, out=off)
                by[1] *= off
                dh, back = np.zeros_like(h), p["U"].reshape(k, 3, k).transpose(1, 2, 0).copy()
                for j in range(steps - 1, -1, -1):
                    dh += dflat[j * lanes : (j + 1) * lanes]
                    by[:, j] *= dh
                    by_n[j] *= dh
                    dh *= z[j]
                    for part in np.matmul(by[:, j], back, out=through):
                        dh += part
                before = prev.reshape(-1, k).T
                dx = sent[: steps * lanes]
                for i in range(3):
                    g["U"][:, i * k : (i + 1) * k] += before @ by[i].reshape(-1, k)
                    dx[:, i] = (by_n if i == 2 else by[i]).reshape(-1, k)
                at, dx_of = _sums(dx.reshape(-1, 3 * k), x.ravel())
                g["E"][at] = dx_of
                g["b"] += dx_of.sum(0)
                norm = float(np.sqrt(np.vdot(grad, grad)))
                t += 1
                done = start + (stop - start) * t / updates
                rate = RATE * min(1.0, t / 20) * (1 - 0.9 * done) * min(1.0, 1.0 / (norm + 1e-9)) / (1 - 0.9**t)
                m *= 0.9
                np.multiply(grad, 0.1, out=room)
                m += room
                grad *= grad
                grad *= 0.01
                v *= 0.99
                v += grad
                np.multiply(v, 1 / (1 - 0.99**t), out=room)
                np.sqrt(room, out=room)
                room += 1e-8
                np.divide(m, room, out=room)
                room *= rate
                row -= room

    def score(self, texts: list[np.ndarray], class_of: np.ndarray, end: int) -> np.ndarray:
        """Natural log-likelihood of each text, given as the inputs of its
        tokens without the end. Texts of like length advance together."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        table, u, k = self.table(), self.gates(), HIDDEN
        every, whole = np.arange(WINDOW), np.empty((WINDOW * GROUP, k), np.float32)
        zr, n, un = np.empty((2, GROUP, k), np.float32), np.empty((GROUP, k), np.float32), np.empty((GROUP, k), np.float32)
        for start in range(0, len(order), GROUP):
            group = order[start : start + GROUP]
            sizes = np.array([len(texts[i]) + 1 for i in group])
            h, total = np.zeros((len(group), k), np.float32), np.zeros(len(group))
            last = np.full(len(group), end, np.int32)
            for begin in range(0, sizes[0], WINDOW):
                live = int(np.searchsorted(-sizes, -begin, side="left"))  # texts longer than begin
                ids = np.full((WINDOW + 1, live), end, np.int32)
                ids[0] = last[:live]
                parts = [texts[i][begin : begin + WINDOW] for i in group[:live]]
                ids[1:].T[every < np.fromiter(map(len, parts), np.int64, live)[:, None]] = np.concatenate(parts)
                ys, rows, upto = [], [], 0
                for j in range(begin, min(begin + WINDOW, sizes[0])):
                    live = int(np.searchsorted(-sizes, -j, side="left"))
                    into = whole[upto : upto + live], zr[:, :live], n[:live], un[:live]
                    h = self.step(h[:live], table.take(ids[j - begin, :live], axis=1), u, into)[0]
                    upto += live
                    ys.append(ids[j - begin + 1, :live]), rows.append(live)
                # the next window writes over these states
                last, h = ids[-1], h.copy()
                y = np.concatenate(ys)
                logp, _ = self.outputs(whole[:upto], class_of[y], y)
                total += np.bincount(np.concatenate([np.arange(size) for size in rows]), weights=logp, minlength=len(group))
            out[group] = total
        return out


class Lookup:
    """Tokens to places in flat arrays of inputs and of scores that need counts
    alone: those whose counts were broadcast first, then one for each rest class."""

    def __init__(self, vocabulary: Vocabulary, top: list[tuple[str, int, int]]):
        v, self.known = vocabulary, len(top)
        self.words = pa.array([w for w, _, _ in top], pa.string())
        short = [v.index.get(w.encode(), -1) for w, _, _ in top]
        self.input = np.array([i if i >= 0 else SHORT + k for i, (_, _, k) in zip(short, top, strict=True)] + [SHORT + k for k in range(REST)], np.uint16)
        self.base = np.array([float(v.base(c)) for _, c, _ in top] + [0.0] * REST)
        self.inside = np.array([0.0 if i >= 0 else v.inside(c, k) for i, (_, c, k) in zip(short, top, strict=True)] + [0.0] * REST)

    def code(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Places of tokens; which of them are not broadcast, and these."""
        places = np.array(pc.index_in(tokens, value_set=self.words.cast(tokens.type)).fill_null(self.known))
        rare = np.flatnonzero(places == self.known)
        found = tokens.take(pa.array(rare)).dictionary_encode()
        places[rare] += rest_classes(found.dictionary)[np.asarray(found.indices)]
        return places, rare, found


def class_table(vocabulary: Vocabulary) -> np.ndarray:
    """The class of each input."""
    return np.concatenate([np.pad(vocabulary.cls, (0, SHORT - len(vocabulary.cls))), CLASSES + np.arange(REST)]).astype(np.int32)


CODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, ids binary, word string, cls int, times long"


def coded_texts(docs: DataFrame, vocabulary: Vocabulary, top: list[tuple[str, int, int]], n_docs: int) -> DataFrame:
    """A row for each row of docs (doc_id, text, held_out), with its inputs and
    with the parts of the scores that the frequent tokens give; and a row
    (uid, word, cls, times) for each other word of it."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps((vocabulary, top)))
    loaded: dict[int, tuple] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            voc, table = pickle.loads(sent.value)
            loaded[0] = voc, Lookup(voc, table)
        voc, look = loaded[0]
        end_base = float(voc.base(n_docs))
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                size = batch.num_rows
                starts, found = words_of_all(batch.column(3))
                places, rare, others = look.code(found)
                text_of = np.repeat(np.arange(size), np.diff(starts))
                far = np.bincount(text_of[rare], minlength=size)
                n_words = np.diff(starts)
                base, inside = (np.bincount(text_of, of[places], size) for of in (look.base, look.inside))
                ids = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((starts * 2).astype(np.int32)), pa.py_buffer(look.input[places])])
                parts = [pa.array(n_words + 1), pa.array(n_words - far + int(n_docs > 0)), pa.array(base + end_base), pa.array(inside), ids]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts, pa.nulls(size, pa.string()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64())], names)
                if len(rare):
                    # a word that a text repeats is one row
                    kinds = len(others.dictionary)
                    pair, times = np.unique(text_of[rare] * kinds + np.asarray(others.indices), return_counts=True)
                    text, word = pair // kinds, others.dictionary.take(pa.array(pair % kinds))
                    gone = [pa.nulls(len(pair), x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *gone, word.cast(pa.string()), pa.array(rest_classes(word)), pa.array(times)], names)

    names = [c.split()[0] for c in CODED.split(", ")]
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(run, CODED)


def dealt(training: DataFrame, rounds: int, shards: int) -> DataFrame:
    """(round, shard, key, ids) of coded training texts: where each is trained on."""
    # the inputs count as well, so that rows with one doc_id (or none) spread
    found = training.select(F.xxhash64(F.lit(17), "doc_id", "ids").alias("key"), "ids")
    place = F.pmod(F.xxhash64(F.lit(18), "key"), F.lit(rounds * shards)).cast("int")
    return found.select(F.floor(place / shards).cast("int").alias("round"), (place % shards).alias("shard"), "key", "ids")


def averaged(parts: DataFrame) -> np.ndarray | None:
    """The parameters of parts (shard, piece, weight, value), weighted, added up
    piece by piece in the order of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for piece, w, value in zip(*(batch.column(c).to_pylist() for c in ("piece", "weight", "value")), strict=True):
                own = np.frombuffer(value, np.float32) * float(w)
                if piece in total:
                    total[piece][0] += w
                    total[piece][1] += own
                else:
                    total[piece] = [w, own.astype(np.float64)]
        for piece, (w, value) in total.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "value": pa.array([(value / w).astype(np.float32).tobytes()], pa.binary())})

    by_piece = parts.repartitionById(PIECES, F.col("piece")).sortWithinPartitions("piece", "shard", "part")
    found = sorted(by_piece.mapInArrow(run, "piece int, value binary").collect())
    return np.concatenate([np.frombuffer(r.value, np.float32) for r in found]) if found else None


def trained_network(training: DataFrame, vocabulary: Vocabulary) -> bytes:
    """The pickled network, trained on all coded texts of training (doc_id, ids)."""
    spark = training.sparkSession
    net = Network(vocabulary)
    rounds = max(1, min(ROUNDS, -(-vocabulary.n // SHARD)))
    shards = max(1, -(-vocabulary.n // (rounds * SHARD)))
    class_of, end = class_table(vocabulary), vocabulary.end
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps(net))

        def run(batches: Iterator[pa.RecordBatch], k=k, sent=sent) -> Iterator[pa.RecordBatch]:
            own, size, at, part = [], 0, None, 0

            def fitted() -> pa.RecordBatch:
                fresh, tokens = pickle.loads(sent.value), np.concatenate(own)
                fresh.train(tokens, class_of[tokens], end, k / rounds, (k + 1) / rounds)
                pieces = np.array_split(fresh.flat(), PIECES)
                return pa.RecordBatch.from_pydict({"shard": pa.array([at] * PIECES, pa.int32()), "part": pa.array([part] * PIECES, pa.int32()), "piece": pa.array(range(PIECES), pa.int32()), "weight": pa.array([len(tokens)] * PIECES, pa.int64()), "value": pa.array([x.tobytes() for x in pieces], pa.binary())})

            for batch in batches:
                for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    # a shard that is far longer than the others is trained in parts
                    if own and (shard != at or size > 4 * SHARD):
                        yield fitted()
                        part, own, size = (part + 1 if shard == at else 0), [], 0
                    at = shard
                    own.append(np.append(np.frombuffer(ids.as_py(), np.uint16), np.uint16(end)))
                    size += len(own[-1])
            if own:
                yield fitted()

        texts = dealt(training, rounds, shards).where(F.col("round") == k).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "ids").select("shard", "ids")
        found = averaged(texts.mapInArrow(run, "shard int, part int, piece int, weight long, value binary"))
        if found is not None:
            net.load(found)
        sent.destroy()
    return pickle.dumps(net)


def lm_scores(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    of each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = Kept(token_counts(training))
    sums = counts.df.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    n_docs = training.count()
    n, v = sums.n + n_docs, sums.v + (n_docs > 0)
    top = frequent_tokens(counts.df, frequent)
    short = spark.createDataFrame([(w,) for w, _, _ in top[: SHORT - 1]], "word string")
    rest = counts.df.join(F.broadcast(short), "word", "left_anti").groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    inside = {r.cls: ((r.n1 + 0.5) / (r.n1 + 2 * r.n2 + 1.0), float(r.c), float(r.k)) for r in rest.collect()}
    vocabulary = Vocabulary([(w, c) for w, c, _ in top], n_docs, inside, n, v)
    # written once: the numbers of rows hold for both kinds of rows in it
    coded = Kept(coded_texts(docs, vocabulary, top, n_docs))
    texts = coded.df.where("word IS NULL")
    net = trained_network(texts.where("NOT held_out").select("doc_id", "ids"), vocabulary)
    sent = spark.sparkContext.broadcast(net)
    class_of, end = class_table(vocabulary), vocabulary.end
    loaded: dict[int, Network] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = loaded.get(0) or loaded.setdefault(0, pickle.loads(sent.value))
        for batch in batches:
            # all at once, so that the few longest texts of a batch advance together
            found = network.score([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(7)], class_of, end) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found + np.asarray(batch.column(6)))], names)

    names = [c.split()[0] for c in CODED.split(", ")[:7]]
    scored = texts.select(*names, "ids").mapInArrow(run, ", ".join(CODED.split(", ")[:7]))
    constants = [vocabulary.rest.get(k, (0.5, 0.0, 0.0)) for k in range(REST)]
    discount, total, kinds = (F.get(F.array(*(F.lit(float(x[j])) for x in constants)), F.col("cls")) for j in range(3))
    c = F.coalesce(F.col("c"), F.lit(0))
    own_base = F.log10((c + 0.1) / F.lit(float(n + 0.1 * (v + 1))))
    inside_class = F.when(total > 0, F.log10(F.when(c > 0, (c - discount) / total).otherwise(discount * kinds / total))).otherwise(0.0)
    far = coded.df.where("word IS NOT NULL").select("uid", "word", "cls", "times").join(counts.df.select("word", "c"), "word", "left")
    far = far.groupBy("uid").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * own_base).alias("base"), F.sum(F.col("times") * inside_class).alias("inside"))
    out = scored.join(far, "uid", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "known"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "base"), plus("score", "inside"))
