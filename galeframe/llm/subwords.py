"""Token ids by a public tokenizer file, each different word encoded once.

The tokenizer drops white space and never joins characters across it, so the
words of a text can be encoded one by one.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Different words that a worker remembers, at about 35 bytes each.
REMEMBERED = 1_000_000


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_padding()
    loaded.no_truncation()
    return loaded


class WordEncoder:
    """Ids of whole texts. Only for tokenizers that lower-case and drop white space, with fewer than 65,536 ids.

    Remembered words stand in sorted arrays: a word is known by its 64-bit hash,
    its length and its first and last byte. When the table is full the half that
    was looked up longest ago is forgotten.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)
        self.now = 0

    def _encode(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and the number of each word's ids."""
        out, length = [], []
        for at in range(0, len(some), 256):
            part = [w.decode() for w in some[at : at + 256]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.array([o[0] for o in found.offsets], dtype=np.int64)
            out.append(np.array(found.ids, dtype=np.uint16))
            length.append(np.diff(np.searchsorted(starts, np.cumsum([0] + [len(w) + 1 for w in part]))))
        return np.concatenate(out), np.concatenate(length).astype(np.int32)

    def _forget(self, room: int) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: max(0, min(REMEMBERED // 2, REMEMBERED - room))])
        length = self.length[keep]
        end = np.cumsum(length, dtype=np.int64)
        self.flat = self.flat[np.arange(length.sum()) + np.repeat(self.first[keep] - (end - length), length)]
        self.key, self.check, self.used = self.key[keep], self.check[keep], self.used[keep]
        self.length, self.first = length, end - length

    def _places(self, found: words.Words, which: np.ndarray) -> np.ndarray:
        """Where in the table the different words ``which``, in the order of their hashes, are; new ones are encoded and added."""
        key = found.value[which]
        begin, end = found.begin[which], found.end[which]
        check = (((end - begin) & 0xFFFF) << 16).astype(np.uint32) | (found.data[begin].astype(np.uint32) << 8) | found.data[end - 1]
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), dtype=bool)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.key) + len(new) > REMEMBERED and len(self.key):
                self._forget(len(new))
                return self._places(found, which)
            text = found.data.tobytes()
            ids, length = self._encode([text[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            where = np.searchsorted(self.key, key[new])
            first = len(self.flat) + np.cumsum(length, dtype=np.int64) - length
            self.flat = np.concatenate([self.flat, ids])
            for name, value in (("key", key[new]), ("check", check[new]), ("first", first), ("length", length), ("used", np.full(len(new), self.now, np.int32))):
                setattr(self, name, np.insert(getattr(self, name), where, value))
            # a clash of hashes leaves the newer word first
            at = np.searchsorted(self.key, key)
        self.used[at] = self.now
        self.now += 1
        return at

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        for i, j, data, bounds in words.blocks(column):
            raw = data.tobytes()
            found = words.split(data, bounds, lower=True)
            _, which, back = np.unique(found.value, return_index=True, return_inverse=True)
            at = self._places(found, which)
            first, length = self.first[at], self.length[at].astype(np.int64)
            n = length[back]
            end = np.cumsum(n)
            source = np.repeat(first[back] - (end - n), n)
            source += np.arange(len(source))
            encoded = self.flat[source].astype("<u4").tobytes()
            cut = (4 * np.concatenate([[0], end])[found.first]).tolist()
            special = any(s in raw for s in self.special)
            for row in range(i, j):
                if special and any(s in raw[bounds[row - i] : bounds[row - i + 1]] for s in self.special):  # their strings may hold or touch white space
                    own = raw[bounds[row - i] : bounds[row - i + 1]].decode()
                    yield np.array(self.tokenizer.encode(own, add_special_tokens=False).ids, dtype="<u4").tobytes()
                else:
                    yield encoded[cut[row - i] : cut[row - i + 1]]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)
