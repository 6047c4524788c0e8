"""Language identification by averaged subword embeddings under a linear softmax.

The hashed character n-grams of a text's words (of the UTF-8 bytes, word ends
marked) have vectors; a text is the mean over its words of the mean over a word's
n-grams, and a linear softmax over the learned languages classifies it.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy, on a bounded sample of the labelled rows. A part of the sample is kept
back: on it the softmax is calibrated (one temperature), and the score below which
a prediction is rejected is chosen so that of the accepted ones at most
``ACCEPTED_ERROR`` are wrong.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fold, small_batches
from .toxicity import subword_buckets as buckets_of_words

#: Bounded fit: the most frequent ``MOST_LANGUAGES`` values are learned, from about
#: ``FIT_ROWS`` rows in all, shared out evenly and chosen by a hash of the row; of
#: a longer text a stretch of ``FIT_CHARS`` characters from a hashed place is read.
#: Rows beyond it are predicted like all others, by their whole texts.
MOST_LANGUAGES = 256
FIT_ROWS = 4000
FIT_CHARS = 1500

SHIFT = 1  # buckets are half of those of the toxicity operator
BUCKETS = 1 << 16
WIDTH = 16
PASSES = 12
RATE = 2.0
KEPT_BACK = 5  # each fifth row of the sample calibrates
ACCEPTED_ERROR = 0.01
UNKNOWN = "und"
SEED = 11


def subword_buckets(found: words.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every subword of the words ``which``."""
    word, bucket = buckets_of_words(found, which)
    return word, bucket >> SHIFT


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return odds / odds.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """Languages, the vectors of the buckets, the softmax with its bias and temperature, and the score below which a prediction is rejected."""

    languages: list[str]
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def columns(self) -> "Model":
        """The same model with a column for each language in place of the vectors, where that is narrower."""
        if len(self.languages) > WIDTH:
            return self
        return Model(self.languages, (self.vectors @ self.softmax).astype(np.float32), np.eye(len(self.languages), dtype=np.float32), self.bias, self.temperature, self.least_score)

    def means(self, found: words.Words) -> np.ndarray:
        """The mean vector of each text of a block; nothing for a text without words."""
        _, which, back = np.unique(found.value, return_index=True, return_inverse=True)
        width = self.vectors.shape[1]
        of_words = np.zeros((len(which), width))
        for at in range(0, len(which), 20_000):
            word, bucket = subword_buckets(found, which[at : at + 20_000])
            n = len(which[at : at + 20_000])
            parts = np.bincount(word, minlength=n)
            for c in range(width):
                of_words[at : at + n, c] = np.bincount(word, self.vectors[bucket, c], minlength=n) / parts
        size = np.diff(found.first)
        doc = np.repeat(np.arange(len(size)), size)
        out = np.zeros((len(size), width))
        for c in range(width):
            out[:, c] = np.bincount(doc, of_words[back, c], minlength=len(size))
        return out / np.maximum(size, 1)[:, None]

    def predict(self, found: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """The number of the likeliest language of each text, of equal ones the first, and its calibrated probability."""
        chance = _softmax((self.means(found) @ self.softmax + self.bias) / self.temperature)
        best = chance.argmax(axis=1)
        return best, chance[np.arange(len(best)), best]


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text and their weights, which sum to one."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    found = words.split(raw, np.array([0, len(raw)]), True, True)
    _, which, n = np.unique(found.value, return_index=True, return_counts=True)
    if len(which) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    word, bucket = subword_buckets(found, which)
    weight = (n / n.sum())[word] / np.bincount(word)[word]
    own, back = np.unique(bucket, return_inverse=True)
    return own, np.bincount(back, weight).astype(np.float32)


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least cross-entropy, of a grid.

    A share of 1 / (n + 2) of each label is given to the other languages, so that
    rows that are all right do not make every score one.
    """
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    aim = np.full(logits.shape, 1 / (len(target) + 2) / (logits.shape[1] - 1))
    aim[np.arange(len(target)), target] = 1 - 1 / (len(target) + 2)
    loss = [-(aim * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _least_score(score: np.ndarray, right: np.ndarray, error: float) -> float:
    """The lowest score so that of the rows at or above it at most ``error`` are wrong; above all scores if there is none."""
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order])
    last_of_ties = np.append(score[order][1:] != score[order][:-1], True)
    fine = np.flatnonzero((wrong <= error * np.arange(1, len(order) + 1)) & last_of_ties)
    return float(score[order][fine[-1]]) if len(fine) else float(np.nextafter(1, 2))


def fit(texts: list[str], languages: list[str], seed: int = SEED) -> Model:
    """Trains on the given rows, in their order; without rows nothing is known, of a single language everything is it."""
    names = sorted(set(languages))
    number = {n: k for k, n in enumerate(names)}
    target = np.array([number[n] for n in languages], dtype=np.int64)
    random = np.random.default_rng(seed)
    vectors = (random.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    softmax = (random.standard_normal((WIDTH, len(names))) * 0.3).astype(np.float32)
    bias = np.zeros(len(names))
    model = Model(names, vectors, softmax, bias)
    if len(names) < 2:
        return model
    bags = [_bag(t) for t in texts]
    kept_back = np.arange(len(texts)) % KEPT_BACK == KEPT_BACK - 1
    rows = np.flatnonzero(~kept_back)
    steps, step = PASSES * len(rows), 0
    for _ in range(PASSES):
        for r in random.permutation(rows):
            bucket, weight = bags[r]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = weight @ vectors[bucket]
            error = _softmax(mean @ softmax + bias)
            error[target[r]] -= 1
            back = softmax @ error
            softmax -= (0.1 * rate * np.outer(mean, error)).astype(np.float32)
            bias -= 0.01 * rate * error
            vectors[bucket] -= (rate * weight[:, None] * len(bucket) ** 0.5 * back).astype(np.float32)
    check = np.flatnonzero(kept_back)
    if len(check):
        logits = np.stack([w @ vectors[b] if len(b) else np.zeros(WIDTH) for b, w in (bags[r] for r in check)]) @ softmax + bias
        model.temperature = _temperature(logits, target[check])
        chance = _softmax(logits / model.temperature)
        model.least_score = _least_score(chance.max(axis=1), chance.argmax(axis=1) == target[check], ACCEPTED_ERROR)
    return model


def fit_rows(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """(lang, text) of the bounded sample, in the order of a hash; no id whose fold is ``held`` is in it."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id"), parts) != held))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    share = counts.select("lang", (F.lit(FIT_ROWS) / F.count(F.lit(1)).over(_all()) / F.col("count")).alias("share"))
    place = F.xxhash64("doc_id", "text", F.lit(SEED))
    stretch = F.substring("text", (F.lit(1) + F.pmod(place, F.greatest(F.length("text") - FIT_CHARS + 1, F.lit(1)))).cast("int"), F.lit(FIT_CHARS))
    chosen = known.withColumn("place", place).join(F.broadcast(share), "lang").where(F.pmod(F.shiftrightunsigned("place", 11), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    # the limit only guards against rows that repeat
    return chosen.select("lang", "place", stretch.alias("text")).orderBy("place", "lang", "text").limit(2 * FIT_ROWS)


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(1))  # at most MOST_LANGUAGES rows


def train(docs: DataFrame, parts: int = 4, held: int = 2) -> Model:
    rows = fit_rows(docs, parts, held).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``.

    Only the whole text goes into a prediction, so equal texts have equal ones.
    A text that is null or has no letter is ``und`` with score 0 and rejected, as
    is every text if no language was learned. A score is the calibrated
    probability of the likeliest language, of equally likely ones the first by
    name; below the model's least score it is marked as rejected, and
    ``lang_pred`` still tells it. Rows with a null id are predicted and count as
    not held out, repeated rows are predicted each. An empty table has no rows,
    and columns of other names are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.columns())

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            some = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if len(names) > 1:
                for i, j, found in words.word_blocks(batch.column(2), lower=True, trim=True):
                    best[i:j], score[i:j] = model.predict(found)
                best[~some], score[~some] = len(names) - 1, 0
            rejected = (score < model.least_score) | (best == len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), parts) == held).alias("held_out"), "text", letters.alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accept_languages(docs: DataFrame, model: Model, languages: list[str]) -> DataFrame:
    """The rows of ``docs`` whose predicted language is one of ``languages`` and not rejected, with all their columns; of rows that share an id each is judged by its own text."""
    columns = docs.columns
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.columns())

    def run(batches):
        model = shared.value
        wanted = np.isin(np.array(model.languages, dtype=object), languages)
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            if len(wanted):
                for i, j, found in words.word_blocks(batch.column(columns.index("text")), lower=True, trim=True):
                    best, score = model.predict(found)
                    keep[i:j] = wanted[best] & (score >= model.least_score)
            yield batch.filter(pa.array(keep))

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
