"""Words of UTF-8 text as numpy arrays, without a Python object for each word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are hashed at once; bounds the working memory of a task.
CHUNK = 1 << 19
#: Bytes of text in the blocks that operators work on; a longer document is a block of its own.
BLOCK = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[0x21:0x7F] = True
for _kept in (slice(0x30, 0x3A), slice(0x41, 0x5B), slice(0x61, 0x7B)):
    _SIGN[_kept] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_UP = _powers(_BASE, CHUNK + 2)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of documents: where they are in ``data`` and, for each document, where its words begin."""

    data: np.ndarray  # bytes of the block
    begin: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    value: np.ndarray  # 64-bit hash of each word
    first: np.ndarray  # number of the first word of each document, and the number of words


def _hash_chunk(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    low, high = int(begin[0]), int(end[-1])
    part = data[low:high].astype(np.uint64) + np.uint64(1)
    n = high - low
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    part *= up[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(part, out=total[1:])
    b, e = begin - low, end - low
    h = (total[e] - total[b]) * down[b]
    return mix(h ^ (mix((e - b).astype(np.uint64) + np.uint64(7))))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the non-empty byte strings ``data[begin[i]:end[i]]``, which stand in order."""
    value = np.empty(len(begin), dtype=np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK, side="right")))
        value[i:j] = _hash_chunk(data, begin[i:j], end[i:j])
        i = j
    return value


def trimmed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without ASCII signs at their ends; a word of signs alone stays as it is."""
    b, e = begin.copy(), end.copy()
    at = np.flatnonzero(_SIGN[data[b]]) if len(b) else np.zeros(0, dtype=np.int64)
    while len(at):
        b[at] += 1
        at = at[b[at] < e[at]]
        at = at[_SIGN[data[b[at]]]]
    empty = b == e
    b[empty] = begin[empty]
    at = np.flatnonzero(_SIGN[data[e - 1]] & ~empty) if len(b) else at
    while len(at):
        e[at] -= 1
        at = at[_SIGN[data[e[at] - 1]]]
    return b, e


def split(data: np.ndarray, bounds: np.ndarray, lower: bool, trim: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the documents ``data[bounds[i]:bounds[i + 1]]``."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        edge[0] = inside[0]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[-1] = inside[-1]
    # a document's border ends a word and begins another
    cut = np.asarray(bounds[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    both = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    at = np.flatnonzero(edge)
    begin, end = at[0::2], at[1::2]
    if len(both):
        begin, end = np.sort(np.concatenate([begin, both])), np.sort(np.concatenate([end, both]))
    first = np.searchsorted(begin, bounds, side="left")
    if trim:
        begin, end = trimmed(data, begin, end)
    return Words(data, begin, end, hashes(data, begin, end), first)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) over a column of strings or of :func:`squeeze`; null counts as empty."""
    if pa.types.is_binary(column.type):
        column = pa.array([zlib.decompress(v.as_py()) if v.is_valid else b"" for v in column], pa.large_binary())
    elif not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def squeeze(texts: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) as (doc_id, body), the compressed text: for texts that have to be shuffled."""

    def run(batches):
        for batch in batches:
            bodies = [zlib.compress((t.as_py() or "").encode(), 1) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["doc_id", "body"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, body binary")


def word_blocks(column: pa.Array, lower: bool, trim: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, their words) over a string column."""
    for i, j, data, bounds in blocks(column):
        yield i, j, split(data, bounds, lower, trim)
