"""Byte-pair encoding and decoding of whole texts with word ends.

Method: each short word is a contiguous array of ranks. It holds the part
boundaries and, between neighbours, the rank of their merge; the loop scans for
the minimum, deletes that boundary and refreshes the two neighbouring ranks.
Here the words of a batch that have the same length advance together, a row
each, in numpy: every step removes one boundary from every live row, so rows
stay equally long and are taken out when no merge is left. Words beyond
``SHORT`` symbols use a heap, so that one long word costs n log n.

Workers keep the encoded form of frequent words in a bounded cache; nothing is
shuffled and nothing is broadcast but the tokenizer's path.

Null texts count as empty: no ids, and the empty decoded text. Special tokens
in a text become their ids, as the library has it by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of a word that is merged in numpy, and words that a worker keeps.
SHORT = 40
CACHE = 150_000
#: Rows that are held in decoded form at once.
ROWS = 256
#: Missing words that are encoded at once.
BLOCK = 20_000
NONE = np.iinfo(np.int32).max
#: Texts of these characters are folded and split here. Others take the
#: library's own normalizer and splitter, whose Unicode tables may be of
#: another version than Python's.
PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u02ff\u2010-\u2027]*").fullmatch


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class WordBpe:
    """A tokenizer read from its JSON file."""

    loaded: dict[str, "WordBpe"] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = np.empty(max([*self.vocab.values(), *self.special.values()]) + 1, dtype=object)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.name = self.names.tolist()
        symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.first = np.array([self.vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([self.vocab[s + end] for s in symbols], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int32), made
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.cache: dict[str, tuple[bytes, str]] = {}

    @classmethod
    def of(cls, path: str) -> WordBpe:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is no such merge."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank_of[at], NONE)

    def merge_rows(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges words of one length, a row each. Returns (places, rows of
        ids) for each length that words end with."""
        done, place = [], np.arange(len(rows))
        ranks = self.ranks(rows[:, :-1], rows[:, 1:])
        while rows.shape[1] > 1 and len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            live = least < NONE
            if not live.all():
                done.append((place[~live], rows[~live]))
                rows, ranks, place, at, least = rows[live], ranks[live], place[live], at[live], least[live]
                if not len(rows):
                    return done
            n, width = rows.shape
            every = np.arange(n)
            rows[every, at] = self.made[least]
            rows = rows[np.arange(width) != (at + 1)[:, None]].reshape(n, width - 1)
            if width == 2:
                break
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            has = at > 0
            ranks[every[has], at[has] - 1] = self.ranks(rows[every[has], at[has] - 1], rows[every[has], at[has]])
            has = at < width - 2
            ranks[every[has], at[has]] = self.ranks(rows[every[has], at[has]], rows[every[has], at[has] + 1])
        if len(rows):
            done.append((place, rows))
        return done

    def merge_long(self, ids: np.ndarray) -> list[int]:
        """The same merges for one long word, by a heap of (rank, place)."""
        ids, n = ids.tolist(), len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        found = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r < NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.ranks(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r < NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x, y in zip(ids, alive, strict=True) if y]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words given as bytes, none of them empty."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size > SHORT:
                for i in at:
                    raw = np.frombuffer(words[i], dtype=np.uint8)
                    out[i] = self.merge_long(np.append(self.first[raw[:-1]], self.last[raw[-1]]))
                continue
            raw = np.frombuffer(b"".join([words[i] for i in at]), dtype=np.uint8).reshape(-1, size)
            rows = np.concatenate([self.first[raw[:, :-1]], self.last[raw[:, -1:]]], axis=1)
            for places, ids in self.merge_rows(rows):
                for i, x in zip(at[places].tolist(), ids.tolist(), strict=True):
                    out[i] = x
        return out

    def chunks(self, text: str | None) -> list[str]:
        """The text in pieces that are encoded each by itself: special tokens
        as they stand, others folded and without white space."""
        out: list[str] = []
        if not text:
            return out
        start = 0
        for m in self.cut.finditer(text) if "<|" in text else ():
            out += self._pieces(text[start : m.start()])
            out.append(m.group())
            start = m.end()
        return out + self._pieces(text[start:] if start else text)

    def _pieces(self, text: str) -> list[str]:
        if PLAIN(text):
            return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        return self.library.normalizer.normalize_str(text).split(" ")

    def _parts(self, chunk: str) -> list[bytes]:
        if PLAIN(chunk):
            return [p.encode() for p in self.split.findall(chunk)]
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """The ids, four bytes each, and the decoded text of chunks."""
        out = {}
        for start in range(0, len(chunks), BLOCK):
            block = chunks[start : start + BLOCK]
            parts: list[bytes] = []
            ends = []
            for c in block:
                if c not in self.special:
                    parts += self._parts(c)
                ends.append(len(parts))
            ids, at, name = self.encode_words(parts), 0, self.name
            for c, end in zip(block, ends, strict=True):
                if end == at + 1:
                    got = ids[at]
                else:
                    got = [self.special[c]] if c in self.special else [i for p in ids[at:end] for i in p]
                at = end
                out[c] = array("I", got).tobytes(), " ".join([name[i] for i in got])
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, four bytes each, and the decoded text. Works
        through a few texts at a time: what they need is held at once, what is
        kept after that is bounded by ``CACHE``."""
        start = 0
        while start < len(texts):
            cut, size, missing = [], 0, set()
            while start + len(cut) < len(texts) and size < 100_000:
                cut.append(self.chunks(texts[start + len(cut)]))
                size += len(cut[-1])
                missing.update(cut[-1])
            start += len(cut)
            cache = self.cache
            if len(cache) + len(missing) > CACHE + 50_000:
                cache.clear()
            cache.update(self.learn([c for c in missing if c not in cache]))
            for chunks in cut:
                got = [cache[c] for c in chunks]
                yield b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def decode(self, ids: bytes) -> str:
        """What the library decodes from ids, special tokens included: the
        tokens with spaces between, since the file names no decoder."""
        return " ".join(self.names[np.frombuffer(ids, dtype="<u4")].tolist())




def bpe_digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id when not given) with n_tokens, ids_sha256 and
    decoded_sha256 of each whole text."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.of(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for ids, decoded in bpe.encode_batch(batch.column(0).to_pylist()):
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], [*batch.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return docs.select(F.col(text), *keep).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """All columns of docs with ``token_ids``, the ids of each whole text, and
    with ``decode`` also ``decoded``, what these ids stand for, in one pass."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.of(path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = [x for x, _ in bpe.encode_batch(batch.column(batch.schema.get_field_index(text)).to_pylist())]
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                columns = [*batch.columns, ids] + ([pa.array(map(bpe.decode, found), pa.string())] if decode else [])
                yield pa.RecordBatch.from_arrays(columns, [*names, "token_ids"] + ["decoded"] * decode)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "token_ids array<int>" + ", decoded string" * decode])
    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """All columns of encoded with ``decoded``, the text that its ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.of(path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
                texts = [None if x is None else " ".join(bpe.names[x].tolist()) if x else "" for x in lists]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])
    return encoded.mapInArrow(run, schema)
