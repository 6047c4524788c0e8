"""Token counts by section: whole documents are encoded once, offsets attribute tokens.

A document has the tokens of its whole text, so that no section changes how its
neighbours are cut. For the byte-level pre-tokenizer these are the tokens of its
words one after another (:class:`OffsetEncoder`), which are remembered; where
that does not hold the text is encoded in one call. A property test holds both
against each other. Tokens come back as character spans; sections are spans too.
Both lists are in order, so joining them by interval is a merge. A token that
crosses a border belongs wholly to the section that holds its first character
that is not white space (of white space alone: its first character).
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts encoded at once, in characters; bounds the working memory of a task.
GROUP_CHARS = 4_000_000
#: Different words that a task remembers; the table is emptied when it is full.
REMEMBERED = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_padding()
    loaded.no_truncation()
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


#: White space beside a space: there a word cannot be encoded apart from its neighbours.
_UNEVEN = re.compile(r" (?=\s)|\s(?= )|^ | $")


class OffsetEncoder:
    """Spans of the tokens of whole texts, each different word encoded once.

    The byte-level pattern never joins characters across a single space between
    two words, except that the space goes with the word after it. A text is
    therefore the sequence of its words, each with the space before it; a text
    with any other white space beside a space is encoded in one call, and so is
    every text where the tokenizer has another pre-tokenizer or a normalizer.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.by_words = str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and self.tokenizer.normalizer is None

    def _learn(self, words: set[str]) -> None:
        joined = [w for w in words if w[:1] == " "]
        for at in range(0, len(joined), 256):
            some = joined[at : at + 256]
            spans = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).offsets, dtype=np.uint32).reshape(-1, 2)
            starts = np.cumsum([0] + [len(w) for w in some])
            # a token's end lies in its own word even where its span begins after the space
            cut = np.searchsorted(spans[:, 1], starts, side="right")
            own = (spans[cut[0] : cut[-1]] - np.repeat(starts[:-1], np.diff(cut)).astype(np.uint32)[:, None]).tobytes()
            at_bytes = ((cut - cut[0]) * 8).tolist()
            self.known.update(zip(some, map(own.__getitem__, map(slice, at_bytes, at_bytes[1:])), strict=True))
        alone = [w for w in words if w[:1] != " "]
        for word, found in zip(alone, self.tokenizer.encode_batch(alone, add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.offsets, dtype=np.uint32).tobytes()

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        split: list[list[str] | None] = []
        for text in texts:
            if not self.by_words or _UNEVEN.search(text):
                split.append(None)
            else:
                words = text.split(" ")
                split.append([words[0], *[" " + w for w in words[1:]]])
        needed = {w for words in split if words for w in words}
        missing = needed - self.known.keys()
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = needed
        self._learn(missing)
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2))
                continue
            found = list(map(self.known.__getitem__, words))
            spans = np.frombuffer(b"".join(found), dtype=np.uint32).astype(np.int64).reshape(-1, 2)
            starts = np.cumsum([0, *map(len, words[:-1])])
            out.append(spans + np.repeat(starts, np.array(list(map(len, found))) // 8)[:, None])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> OffsetEncoder:
    """One encoder for all tasks of a Python worker."""
    return OffsetEncoder(path)


def sections(text: str) -> np.ndarray:
    """Borders of the sections: a section is a line with the newline that ends it. The empty text is one empty section."""
    if not text:
        return np.array([0, 0])
    at = [0]
    found = text.find("\n")
    while found >= 0:
        at.append(found + 1)
        found = text.find("\n", found + 1)
    if at[-1] != len(text):
        at.append(len(text))
    return np.array(at)


def attribute(text: str, begin: np.ndarray, end: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each section the tokens given to it, and how many of those end beyond it.

    ``begin`` and ``end`` are the tokens' spans in order.
    """
    n = len(borders) - 1
    # only tokens that touch a border can begin with white space of another section
    owner = np.searchsorted(borders, begin, side="right") - 1
    last = np.searchsorted(borders, np.maximum(end - 1, begin), side="right") - 1
    for token in np.flatnonzero((last != owner) & (end > begin)).tolist():
        a, b = int(begin[token]), int(end[token])
        inner = a + len(text[a:b]) - len(text[a:b].lstrip())
        if inner < b:
            owner[token] = np.searchsorted(borders, inner, side="right") - 1
    owner = np.clip(owner, 0, n - 1)
    return np.bincount(owner, minlength=n), np.bincount(owner, (last > owner) & (end > begin), minlength=n).astype(np.int64)


COLUMNS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def count(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section of each document.

    doc_id; section (from 0); start and end in code points; n_tokens given to
    it; n_crossing of these that end beyond it; doc_tokens of the whole text.
    Sections' n_tokens sum to doc_tokens. A null or empty text is one empty
    section without tokens; an empty table gives no rows. Repeated rows give
    repeated results; a very long text is a group of its own; other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                group, size, first = [], 0, at
                while at < len(ids) and (size < GROUP_CHARS or not group):
                    group.append(texts[at].as_py() or "")
                    size += len(group[-1])
                    at += 1
                doc, number, start, end, tokens, crossing, whole = ([] for _ in range(7))
                for k, (text, spans) in enumerate(zip(group, coder.spans(group), strict=True)):
                    borders = sections(text)
                    n, over = attribute(text, spans[:, 0], spans[:, 1], borders)
                    doc += [ids[first + k]] * len(n)
                    number.append(np.arange(len(n), dtype=np.int32))
                    start.append(borders[:-1])
                    end.append(borders[1:])
                    tokens.append(n)
                    crossing.append(over)
                    whole.append(np.full(len(n), len(spans)))
                columns = [pa.array(doc, pa.int64())] + [pa.array(np.concatenate(c)) for c in (number, start, end, tokens, crossing, whole)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COLUMNS)
