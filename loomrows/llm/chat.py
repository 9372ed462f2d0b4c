"""Chat formatting of whole conversations by columnar byte assembly.

Template: each turn becomes

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

and turns follow one another without anything between. Control strings (those
above and the usual ones of other templates, ``CONTROL``) inside roles and
texts are broken by a backslash after their first character, and a broken one
gets one more backslash; ``unescape`` takes one away, so that every text comes
back as it was. The loss mask covers the texts of assistant turns.

Method: the batch's roles and texts are Arrow buffers. Lengths of segments,
cumulative offsets and scatter indices are computed in numpy, and headers and
contents are copied into one preallocated buffer, which is the new column.

Rows of a conversation are ordered by turn, then role, then text (a tie is
broken by content, so reruns agree). Null texts and roles are empty, a null
conv_id is a conversation of its own, repeated rows are repeated turns; other
columns are ignored. Rows are dealt by conversation and sorted; a conversation
streams through its task batch by batch, so that its length isn't held. One
conversation is one task: turns of one are never split among several.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = b"<|im_start|>", b"<|im_sep|>", b"<|im_end|>"
#: Control strings without their first character, as regular expressions.
CONTROL = [r"\|im_start\|>", r"\|im_sep\|>", r"\|im_end\|>", r"\|endoftext\|>", r"/?s>", r"/?INST\]", r"</?SYS>>"]
_TAIL = "|".join(CONTROL)
_ADD = rf"([<\[])(\\*)({_TAIL})"
_TAKE = re.compile(rf"([<\[])\\(\\*)({_TAIL})".encode())
_TURN = re.compile(re.escape(START) + b"(.*?)" + re.escape(SEP) + b"(.*?)" + re.escape(END), re.S)
#: Bytes of a turn's frame.
FRAME = len(START) + len(SEP) + len(END)


def escape(column: pa.Array) -> pa.Array:
    """Control strings inside texts broken; null is empty."""
    column = pc.fill_null(column, "")
    return pc.replace_substring_regex(column, pattern=_ADD, replacement=r"\1\\\2\3")


def unescape(raw: bytes) -> bytes:
    return _TAKE.sub(rb"\1\2\3", raw) if b"\\" in raw else raw


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each begins (one more at the end)."""
    column = pc.cast(column, pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), at


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Copies segments data[begin : begin + size] to out[to:], all at once."""
    total = int(size.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + within] = data[np.repeat(begin, size) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """The formatted turn of each row."""
    (role, r), (text, t) = _flat(escape(roles)), _flat(escape(texts))
    r_len, t_len = np.diff(r), np.diff(t)
    offsets = np.concatenate([[0], np.cumsum(r_len + t_len + FRAME)])
    out, at = np.empty(int(offsets[-1]), np.uint8), offsets[:-1].copy()
    for piece, data, begin, size in ((START, role, r[:-1], r_len), (SEP, text, t[:-1], t_len), (END, None, None, None)):
        mark = np.frombuffer(piece, np.uint8)
        out[at[:, None] + np.arange(len(mark))] = mark
        at += len(mark)
        if data is not None:
            _scatter(out, at, data, begin, size)
            at += size
    return pa.LargeStringArray.from_buffers(len(r_len), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text."""
    return [(unescape(r).decode(), unescape(t).decode()) for r, t in _TURN.findall(formatted)]


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and ``formatted`` of each row, the rows of a
    conversation together and in order. Joining the pieces of a conversation
    in that order gives its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pc.cast(assemble(batch.column(2), batch.column(3)), pa.string())], ["conv_id", "turn", "role", "formatted"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered(rows).mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, formatted string")


def ordered(rows: DataFrame) -> DataFrame:
    """Conversations dealt over tasks, rows in order."""
    rows = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class _Digest:
    """What is read back from one conversation's formatted turns."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: bytes) -> None:
        self.chars += len(formatted.decode())
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def chat_digests(rows: DataFrame) -> DataFrame:
    """Formats conversations and returns for each what is read back from the
    output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            data, at = _flat(assemble(batch.column(2), batch.column(3)))
            data, start = data.tobytes(), 0
            for i in range(1, len(names) + 1):
                if i < len(names) and names[i] == names[start]:
                    continue
                if digest is None or names[start] != now:
                    if digest is not None:
                        out.append((now, *digest.row()))
                    now, digest = names[start], _Digest()
                digest.add(data[at[start] : at[i]])
                start = i
            if out:
                yield _batch(out, kind)
        if digest is not None:
            yield _batch([(now, *digest.row())], kind)

    spark_kind = rows.schema["conv_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[spark_kind]
    return ordered(rows).mapInArrow(run, f"conv_id {spark_kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
