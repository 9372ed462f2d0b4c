"""Token counts of whole texts by a piece tokenizer, without any shuffle of
pre-tokens.

Method: a two-tier lookup on the map side. One pass gathers the most frequent
pre-tokens of all texts as bounded summaries (each task keeps at most
``SUMMARY`` counters and prunes the rest, summaries meet in a tree), the driver
encodes these at most ``FREQUENT`` strings once, and broadcasts the strings as
one Arrow buffer with their lengths (some 400 kB), which is hashed in native
code. A second pass splits texts into columns of pre-tokens, a few MB at a time
and long texts in parts, looks all of them up at once, and encodes distinct
misses through a bounded cache of the Python worker, which is apart from the
table. The last merge of summaries is one task of bounded size.

A text may be cut into pre-tokens because no piece of the vocabulary holds a
non-space followed by the space mark, or a line feed: merges never cross such a
place. ``PieceCounter`` asserts that when it loads a model. Texts with runs of
spaces, spaces at an end or a literal space mark are encoded in one piece.

Null and empty texts have no tokens and no bytes. Repeated rows are counted
each by itself; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table (a few MB), of a task's summary, and of a worker's cache.
FREQUENT = 32_768
SUMMARY = 65_536
CACHE = 200_000
#: Pre-tokens longer than this are encoded but never kept.
LONG = 64
#: Characters of text that are split at a time.
PART = 1 << 21
#: Summaries that one task merges.
FAN_IN = 32

MARK = "▁"


class PieceCounter:
    """Token counts by one model: a table of frequent pre-tokens, and a cache
    of others that is emptied when it is full."""

    loaded: dict[str, PieceCounter] = {}

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError("a piece crosses the places where texts are cut")
        self.words, self.lengths = pa.array([], pa.string()), np.empty(0, np.int64)
        self.cache: dict[str, int] = {}

    @classmethod
    def of(cls, model_file: str) -> PieceCounter:
        if model_file not in cls.loaded:
            cls.loaded[model_file] = cls(model_file)
        return cls.loaded[model_file]

    def length(self, word: str) -> int:
        # The model puts one space mark before what it encodes. After a line
        # feed there is none: the mark then stands alone, and is one too many.
        return len(self.model.encode(word)) - (word[:1] == "\n")

    def cached(self, word: str) -> int:
        n = self.cache.get(word)
        if n is None:
            n = self.length(word)
            if len(word) <= LONG:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = n
        return n

    def lookup(self, words: pa.StringArray) -> np.ndarray:
        """Lengths of pre-tokens."""
        at = pc.index_in(words, value_set=self.words)
        missing = at.is_null()
        out = self.lengths[np.asarray(at.fill_null(0))] if len(self.words) else np.zeros(len(words), np.int64)
        gone = np.asarray(missing)
        if gone.any():
            rest = words.filter(missing).dictionary_encode()
            own = np.fromiter(map(self.cached, rest.dictionary.to_pylist()), np.int64, len(rest.dictionary))
            out[gone] = own[np.asarray(rest.indices)]
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for rows, words, starts in split(texts):
            if words is None:
                out[rows] = len(self.model.encode(texts[rows].as_py()))
            else:
                np.add.at(out, rows, np.add.reduceat(self.lookup(words), starts))
        return out


def parts_of(cut: str) -> Iterator[str]:
    """A text that is split at spaces, in parts of about PART characters."""
    start = 0
    while len(cut) - start > 2 * PART and (end := cut.find(" ", start + PART)) > 0:
        yield cut[start:end]
        start = end + 1
    yield cut[start:]


def spaced(text: str) -> str | None:
    """A text whose pre-tokens stand between single spaces; None if it can't be
    cut this way."""
    whole = text.replace("\n", " \n")
    return None if "  " in whole or whole[:1] == " " or whole[-1:] == " " or MARK in whole else whole


def split(texts: pa.Array) -> Iterator[tuple]:
    """(rows, pre-tokens, starts): rows whose pre-tokens begin at starts; a row
    may come in several parts. A pre-token is what stands after one space, or
    after none with a line feed in front. For a text that can't be cut this way:
    (row, None, None). Null and empty texts don't come."""
    rows: list[int] = []
    parts: list[str] = []

    def cut() -> tuple:
        lists = pc.split_pattern(pa.array(parts, pa.string()), " ")
        return np.array(rows), lists.flatten(), np.asarray(lists.offsets)[:-1]

    size = 0
    for row, value in enumerate(texts):
        text = value.as_py()
        if not text:
            continue
        whole = spaced(text)
        if whole is None:
            yield row, None, None
            continue
        for part in parts_of(whole):
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= PART:
                yield cut()
                rows, parts, size = [], [], 0
    if rows:
        yield cut()


def _summary(counts: Counter, most: int) -> bytes:
    return pickle.dumps(counts.most_common(most), 5)


def frequent_pretokens(texts: DataFrame, column: str, most: int = FREQUENT) -> list[str]:
    """Up to ``most`` pre-tokens that are frequent in the whole table. Each
    task sends one bounded summary; they are merged in a tree."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                whole = spaced(value.as_py() or "")
                for part in parts_of(whole) if whole else ():
                    counts.update([w for w in part.split(" ") if len(w) <= LONG])
                    if len(counts) > 4 * SUMMARY:
                        counts = Counter(dict(counts.most_common(SUMMARY)))
        yield pa.RecordBatch.from_pydict({"summary": [_summary(counts, most)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for summary in batch.column(0).to_pylist():
                counts.update(dict(pickle.loads(summary)))
                if len(counts) > 4 * SUMMARY:
                    counts = Counter(dict(counts.most_common(SUMMARY)))
        yield pa.RecordBatch.from_pydict({"summary": [_summary(counts, most)]})

    summaries = texts.select(column).mapInArrow(gather, "summary binary")
    n = texts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN_IN)
        summaries = summaries.repartition(n).mapInArrow(merge, "summary binary")
    counts = Counter()
    for row in summaries.collect():  # one row
        counts.update(dict(pickle.loads(row.summary)))
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def token_counts(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """``keep`` columns of docs with n_bytes, n_tokens and over_limit.

    Args:
        docs: a table with a string column ``text``.
        model_file: path of the tokenizer's model, readable on each executor.
        keep: columns to return beside the counts (doc_id when not given).
        limit: n_tokens above it sets over_limit.
        frequent: entries of the broadcast table.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    counter = PieceCounter.of(model_file)
    words = frequent_pretokens(docs, text, frequent) if frequent else []
    sent = spark.sparkContext.broadcast((pa.array(words, pa.string()), np.fromiter(map(counter.length, words), np.int64, len(words))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceCounter.of(model_file)
        own.words, own.lengths = sent.value
        for batch in batches:
            texts = batch.column(0)
            sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            tokens = pa.array(own.counts(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes, tokens, pc.greater(tokens, limit)], [*batch.schema.names[1:], "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_bytes long", "n_tokens long", "over_limit boolean"])
    return docs.select(F.col(text), *keep).mapInArrow(count, schema)
