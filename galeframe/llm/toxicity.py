"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (of the UTF-8 bytes,
with word ends marked) and has no vector of its own, so a misspelling that was
never seen shares most vectors with the word it stands for. Vectors of a window
of ``WINDOW`` words are averaged and classified by a linear softmax, and a
document is as toxic as its most toxic window; embeddings and softmax are
trained jointly in numpy. Since everything below the softmax is linear, scoring
needs one number for each n-gram bucket, which is all that is sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fold, small_batches

#: Bounded fit: at most so many labelled rows of each label, of at most so many
#: bytes, chosen by a hash of the id. Rows beyond it are scored like all others.
FIT_ROWS = 3000
FIT_BYTES = 20_000

BUCKETS = 1 << 17
WIDTH = 8
WINDOW = 2
NGRAMS = (2, 3, 4, 5)
#: Training ends when the mean loss of ``PATIENCE`` steps is no longer ``FALLING`` of what it was that many steps before, or is below ``LEAST_LOSS``, and after ``MOST_STEPS`` at the latest.
PATIENCE, FALLING, LEAST_LOSS, MOST_STEPS = 400, 0.9, 0.01, 6000
BATCH = 64
#: Models of different seeds that are averaged: scores are linear, so the average is one model.
MODELS = 3
#: Bytes of prepared batches that training keeps; others are put together again in every pass.
KEPT_BYTES = 32 << 20
RATE = 0.4
SEED = 7
THRESHOLD = 0.7


def subword_buckets(found: words.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every subword of the words ``which``; words are numbered by their place in ``which``."""
    begin, size = found.begin[which], (found.end - found.begin)[which]
    marked = size + 2
    at = np.concatenate([[0], np.cumsum(marked)])
    word = np.repeat(np.arange(len(which)), marked)
    inner = np.arange(at[-1]) - at[word]
    source = begin[word] + inner - 1
    last = inner == marked[word] - 1
    byte = np.where(inner == 0, ord("<"), np.where(last, ord(">"), found.data[np.clip(source, 0, len(found.data) - 1)])).astype(np.uint64)
    out_word, out_bucket = [], []
    for n in NGRAMS:
        start = np.flatnonzero(inner + n <= marked[word])
        h = np.full(len(start), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + byte[start + k]
        out_word.append(word[start])
        out_bucket.append(words.mix(h))
    return np.concatenate(out_word), (np.concatenate(out_bucket) & np.uint64(BUCKETS - 1)).astype(np.int64)


def window_logits(scalars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: the largest window mean, and that window's first and last word. No words: 0 and an empty window."""
    total = np.concatenate([[0.0], np.cumsum(scalars, dtype=np.float64)])
    n = np.diff(first)
    width = np.minimum(n, WINDOW)
    starts = np.where(n > 0, n - width + 1, 0)  # windows of each document
    doc = np.repeat(np.arange(len(n)), starts)
    if len(doc) == 0:
        return np.zeros(len(n)), first[:-1], first[:-1]
    begin_of = np.concatenate([[0], np.cumsum(starts)])
    place = first[:-1][doc] + np.arange(len(doc)) - begin_of[doc]
    mean = (total[place + width[doc]] - total[place]) / width[doc]
    some = np.flatnonzero(n > 0)
    best = np.zeros(len(n))
    best[some] = np.maximum.reduceat(mean, begin_of[some])
    top = np.flatnonzero(mean == best[doc])
    where = first[:-1].copy()
    where[doc[top[::-1]]] = place[top[::-1]]  # the first of equal windows
    return best, where, where + width


@dataclass
class Model:
    """One number for each bucket, and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, found: words.Words) -> np.ndarray:
        """Score of each document of the block."""
        _, which, back = np.unique(found.value, return_index=True, return_inverse=True)
        scalars = np.zeros(len(which))
        for at in range(0, len(which), 20_000):
            word, bucket = subword_buckets(found, which[at : at + 20_000])
            n = len(which[at : at + 20_000])
            scalars[at : at + n] = np.bincount(word, self.weight[bucket], minlength=n) / np.bincount(word, minlength=n)
        logit, _, _ = window_logits(scalars[back], found.first)
        return 1 / (1 + np.exp(-np.clip(logit + self.bias, -30, 30)))


@dataclass
class _Prepared:
    """The words of all training texts as numbers, and the subwords of each different word once."""

    words: list[np.ndarray]  # of each text
    at: np.ndarray  # where each word's buckets begin, and the end
    bucket: np.ndarray

    def batch(self, rows: np.ndarray):
        """first, back, word, bucket, parts of a batch: its texts' words numbered anew, and their subwords."""
        n = np.array([len(self.words[r]) for r in rows])
        which, back = np.unique(np.concatenate([self.words[r] for r in rows]), return_inverse=True)
        parts = self.at[which + 1] - self.at[which]
        end = np.cumsum(parts)
        source = np.arange(parts.sum()) + np.repeat(self.at[which] - (end - parts), parts)
        return np.concatenate([[0], np.cumsum(n)]), back, np.repeat(np.arange(len(which)), parts), self.bucket[source], parts


def _prepared(texts: list[str]) -> _Prepared:
    """Words are numbered in the order they are first met; what is known of them stands in arrays sorted by hash, not in objects."""
    known, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    of_texts, parts, buckets = [], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for at in range(0, len(texts), BATCH):
        raw = [t.encode() for t in texts[at : at + BATCH]]
        found = words.split(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), True, True)
        value, which, back = np.unique(found.value, return_index=True, return_inverse=True)
        place = np.searchsorted(known, value)
        new = (place == len(known)) | (known[np.minimum(place, max(len(known) - 1, 0))] != value) if len(known) else np.ones(len(value), dtype=bool)
        if new.any():
            word, bucket = subword_buckets(found, which[new])
            order = np.argsort(word, kind="stable")
            buckets.append(bucket[order].astype(np.int32))
            parts.append(np.bincount(word, minlength=int(new.sum())))
            numbers = np.insert(numbers, place[new], np.arange(len(known), len(known) + int(new.sum()), dtype=np.int32))
            known = np.insert(known, place[new], value[new])
        own = numbers[np.searchsorted(known, value)][back]
        of_texts += [own[a:b].copy() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    return _Prepared(of_texts, np.cumsum(np.concatenate(parts)), np.concatenate(buckets))


def _settled(losses: list[float]) -> bool:
    """Whether the loss has stopped falling; looked at between passes."""
    if len(losses) < 2 * PATIENCE:
        return False
    last = float(np.mean(losses[-PATIENCE:]))
    return len(losses) >= MOST_STEPS or last < LEAST_LOSS or last > FALLING * float(np.mean(losses[-2 * PATIENCE : -PATIENCE]))


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """Trains embeddings and softmax together, in numpy, by Adagrad.

    The first pass averages whole documents, so that words find their sides; the
    others average the window that scores highest (the first of equal ones), until
    the loss has stopped falling. Rows that repeat are learned as often as they
    stand there. ``MODELS`` such models are averaged, since one alone may place a
    misspelling badly. Without texts of both labels the score is the share of label 1.
    """
    return _fit(_prepared(texts), labels, seed)


def _fit(prepared: _Prepared, labels: np.ndarray, seed: int = SEED) -> Model:
    labels = np.asarray(labels, dtype=np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        share = labels.mean() if len(labels) else 0.5
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    order = np.random.default_rng(seed).permutation(len(labels))
    batches = _Batches(prepared, labels, [order[at : at + BATCH] for at in range(0, len(order), BATCH)])
    models = [_fit_one(batches, seed + k) for k in range(MODELS)]
    return Model(np.mean([m.weight for m in models], axis=0, dtype=np.float32), float(np.mean([m.bias for m in models])))


class _Batches:
    """Prepared batches with their labels, kept up to ``KEPT_BYTES``."""

    def __init__(self, prepared: _Prepared, labels: np.ndarray, rows: list[np.ndarray]):
        self.prepared, self.labels, self.rows = prepared, labels, rows
        self.kept: dict[int, tuple] = {}
        self.room = KEPT_BYTES

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, number: int):
        made = self.kept.get(number)
        if made is None:
            made = self.prepared.batch(self.rows[number])
            made = (made[0], *(a.astype(np.int32) for a in made[1:]))
            size = sum(a.nbytes for a in made)
            if size <= self.room:
                self.room -= size
                self.kept[number] = made
        return made, self.labels[self.rows[number]]


def _fit_one(batches: _Batches, seed: int) -> Model:
    random = np.random.default_rng(seed)
    vectors = (random.standard_normal((BUCKETS, WIDTH)) * 0.05).astype(np.float32)
    softmax = (random.standard_normal((WIDTH, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2)
    vectors_seen = np.full(BUCKETS, 1e-3, dtype=np.float32)
    softmax_seen = np.full((WIDTH, 2), 1e-3, dtype=np.float32)
    bias_seen = np.full(2, 1e-3)
    losses: list[float] = []
    epoch = -1
    while not _settled(losses):
        epoch += 1
        for number in random.permutation(len(batches)):
            (first, back, word, bucket, parts), target = batches[number]
            if len(back) == 0:
                losses.append(0.0)
                continue
            n = np.diff(first)
            side = softmax[:, 1] - softmax[:, 0]
            scalars = np.bincount(word, (vectors @ side)[bucket], minlength=len(parts)) / parts
            if epoch == 0:
                begin, end = first[:-1], first[1:]
                logit = np.bincount(np.repeat(np.arange(len(n)), n), scalars[back], minlength=len(n)) / np.maximum(n, 1)
            else:
                logit, begin, end = window_logits(scalars[back], first)
            probability = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -30, 30)))
            error = (probability - target) / len(target)
            losses.append(float(-np.log(np.maximum(np.where(target == 1, probability, 1 - probability), 1e-12)).mean()))
            # each document's error goes to the words of its window, and from each word to its subwords
            step = np.zeros(len(back) + 1)
            share = np.where(end > begin, error / np.maximum(end - begin, 1), 0)
            np.add.at(step, begin, share)
            np.add.at(step, end, -share)
            of_word = np.bincount(back, np.cumsum(step)[:-1], minlength=len(parts)) / parts
            touched = np.flatnonzero(of_word[word])
            slots, place = np.unique(bucket[touched], return_inverse=True)
            push = np.bincount(place, of_word[word[touched]]).astype(np.float32)
            mean_vector = push @ vectors[slots]  # the gradient of the softmax before it moves
            vectors_seen[slots] += push**2 * (side @ side)
            vectors[slots] -= (RATE * push / np.sqrt(vectors_seen[slots]))[:, None] * side
            for column, sign in ((1, 1.0), (0, -1.0)):
                gradient = sign * mean_vector
                softmax_seen[:, column] += gradient**2
                softmax[:, column] -= 0.1 * gradient / np.sqrt(softmax_seen[:, column])
                slope = sign * error.sum()
                bias_seen[column] += slope**2
                bias[column] -= 0.1 * slope / np.sqrt(bias_seen[column])
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_rows(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> DataFrame:
    """(text, toxic) of the bounded sample; no id whose fold is ``held`` is in it."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held)).select("doc_id", "toxic")
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    some = None
    for label in (0, 1):
        chosen = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(rows)
        some = chosen if some is None else some.unionByName(chosen)
    # at most 2 x rows ids: a proven bound for the broadcast
    text = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes)
    return text.join(F.broadcast(some.dropDuplicates(["doc_id"])), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    # the limit only guards against an id that repeats; the order makes it the same rows in every run
    rows = fit_rows(docs, labels).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(4 * FIT_ROWS).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    labels_of = np.array([r["toxic"] for r in rows])
    prepared = _prepared([r["text"] for r in rows])
    del rows  # the driver holds the texts only until their words are numbered
    return _fit(prepared, labels_of)


def score(docs: DataFrame, model: Model, parts: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only the text goes into a score: equal texts have equal scores. A null or
    empty text has the score of the bias alone. Rows with a null id are scored
    and count as not held out. Columns of other names are not looked at.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, found in words.word_blocks(batch.column(2), lower=True, trim=True):
                out[i:j] = model.scores(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), parts) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    columns = docs.columns
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, j, found in words.word_blocks(batch.column(columns.index("text")), lower=True, trim=True):
                keep[i:j] = model.scores(found) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
