"""Language-model scores of whole texts: a unigram base and a causal attention model.

Every text is encoded once; its subword ids are kept beside it. Words and
subwords are counted over every training document. The training documents are
dealt by a hash into shards of about ``SHARD_IDS`` ids, whatever the partitions
of the table are; each shard trains the model on every id of its documents, in
the order of their hashes and from the same start, and what the shards learned
is averaged. So scores depend on the table alone, not on how it is partitioned.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .attention_lm import Model
from .common import fold, settled, small_batches, stored
from .subwords import default_path, word_encoder

#: Words with at least this share of all tokens are looked up where the text is; so there are at most 1 / share.
FREQUENT_SHARE = 1 / 1_000_000
#: Training ids of a shard on average; a shard is trained on by one task.
SHARD_IDS = 4_000_000
VOCABULARY = 49_408
END_ID = 49_407


# --- counts


def _word_counts(texts: DataFrame) -> DataFrame:
    """(key, n): every different word of the training texts by its 64-bit hash, summed by task and then over all."""

    def run(batches):
        for batch in batches:
            for _, _, found in words.word_blocks(batch.column(0), lower=True):
                if len(found.value):
                    key, n = np.unique(found.value, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """``texts`` with the ids of each text (16-bit, little-endian) and their number."""

    def run(batches):
        encoder = word_encoder(path)
        for batch in batches:
            ids = [np.frombuffer(b, dtype="<u4").astype("<u2").tobytes() for b in encoder.ids(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([len(b) // 2 for b in ids], pa.int64())], names=["doc_id", "fold", "text", "ids", "n_ids"])

    return texts.mapInArrow(run, "doc_id long, fold int, text string, ids binary, n_ids long")


def _ids(column: pa.Array):
    return (np.frombuffer(b.as_buffer(), dtype="<u2").astype(np.int32) for b in column)


def _subword_counts(training: DataFrame) -> np.ndarray:
    """Occurrences of every subword id in the training texts; a table as long as the vocabulary."""

    def run(batches):
        total = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in batches:
            # a batch of texts is bounded
            total += np.bincount(np.concatenate([np.zeros(0, np.int32), *_ids(batch.column(0))]), minlength=VOCABULARY)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["id", "n"])

    rows = training.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(VOCABULARY, dtype=np.int64)
    for row in rows:
        out[row["id"]] = row["n"]
    return out


# --- training


def _keep_freed() -> None:
    """Lets glibc keep up to 60 MB of freed memory, twice the largest array that was freed: else each batch's arrays are mapped and cleared anew."""
    freed = np.empty(30 << 20, dtype=np.uint8)
    del freed


_LEARNED = "part int, slot int, weight double, " + ", ".join(f"v{k} double" for k in range(9))


def _dense(model: Model) -> np.ndarray:
    """All parameters that every window uses, as one table."""
    return np.concatenate([getattr(model, n) for n in Model.DENSE]).astype(float)


def _head(model: Model) -> np.ndarray:
    """The vectors of the tree's nodes with their biases."""
    return np.hstack([model.head, model.bias[:, None]]).astype(float)


def _train(training: DataFrame, start: Model, shard_ids: int = SHARD_IDS) -> Model:
    """The average of what the shards learn from the same start, weighted by how often each touched a row."""
    shards = max(1, -(-(training.agg(F.sum("n_ids")).first()[0] or 0) // shard_ids))

    def learn(texts):
        model = start.copy()
        seen, tokens = model.fresh(), 0
        for ids, target, scored, _ in model.batches(texts, END_ID):
            model.train(ids, target, seen, scored)
            tokens += int(scored.sum())
        embed, dense = (np.hstack([c, np.zeros((len(c), 1))]) for c in (model.embed - start.embed, _dense(model) - _dense(start)))
        for part, change, weight in ((0, embed, seen["embed_touches"]), (1, dense, np.full(len(dense), float(tokens))), (2, _head(model) - _head(start), seen["head_touches"])):
            slot = np.flatnonzero(weight)
            w = np.sqrt(weight[slot])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slot), part, dtype=np.int32)), pa.array(slot.astype(np.int32)), pa.array(w), *(pa.array(change[slot, k] * w) for k in range(9))],
                names=[c.split()[0] for c in _LEARNED.split(", ")],
            )

    def run(batches):
        _keep_freed()
        rows = ((shard, ids) for batch in batches for shard, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1)), strict=True))
        for _, texts in itertools.groupby(rows, key=lambda r: r[0]):
            yield from learn(ids for _, ids in texts)

    order = F.xxhash64("doc_id", "ids")
    dealt = training.select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), "ids", order.alias("place"), "doc_id")
    dealt = dealt.repartitionByRange(int(shards), "shard").sortWithinPartitions("shard", "place", "doc_id").select("shard", "ids")
    total = dealt.mapInArrow(run, _LEARNED).groupBy("part", "slot").agg(F.sum("weight").alias("weight"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(9)))
    # as many rows as the model has, whatever the input
    learned = total.toArrow()
    part, slot, weight = (learned[c].to_numpy() for c in ("part", "slot", "weight"))
    change = np.stack([learned[f"v{k}"].to_numpy() for k in range(9)], axis=1) / np.maximum(weight, 1e-9)[:, None] if len(part) else np.zeros((0, 9))
    model = start.copy()
    model.embed[slot[part == 0]] += change[part == 0, :8].astype(np.float32)
    dense = _dense(model)
    dense[slot[part == 1]] += change[part == 1, :8]
    at = 0
    for name in Model.DENSE:
        n = len(getattr(model, name))
        setattr(model, name, dense[at : at + n].astype(np.float32))
        at += n
    model.head[slot[part == 2]] += change[part == 2, :8].astype(np.float32)
    model.bias[slot[part == 2]] += change[part == 2, 8].astype(np.float32)
    return model


# --- scoring

_SCORED = "row long, key long, is_text boolean, doc_id long, fold int, n_words long, known long, base double, n long, score double"


def _score(encoded: DataFrame, model: Model, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row per text with what is known where the text is, and one per rarer word of each text."""

    def run(batches):
        _keep_freed()
        keys, logs = frequent
        for batch in batches:
            size = batch.num_rows
            rows = batch.column(4).to_numpy()
            n_words, known, base = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
            rare: list[list[np.ndarray]] = [[], [], []]
            for i, j, found in words.word_blocks(batch.column(2), lower=True):
                n = np.diff(found.first)
                doc = np.repeat(np.arange(i, j), n)
                # each different word of the block is looked up once, in order
                different, of = np.unique(found.value, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, different), max(len(keys) - 1, 0))
                is_common = keys[at] == different if len(keys) else np.zeros(len(different), dtype=bool)
                log = np.where(is_common, logs[at], 0.0) if len(keys) else np.zeros(len(different))
                hit = is_common[of]
                n_words[i:j] = n
                known[i:j] = np.bincount(doc[hit] - i, minlength=j - i)
                base[i:j] = np.bincount(doc - i, log[of], minlength=j - i)
                order = np.lexsort((found.value[~hit], doc[~hit]))
                d, v = doc[~hit][order], found.value[~hit][order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])) if len(d) else np.zeros(0, dtype=np.int64)
                rare[0].append(rows[d[new]])
                rare[1].append(v[new])
                rare[2].append(np.diff(np.append(new, len(d))))
            score = model.score_texts(list(_ids(batch.column(3))), END_ID)
            names = [c.split()[0] for c in _SCORED.split(", ")]
            spread = words.mix(rows.astype(np.uint64)).view(np.int64)  # no word: only deals texts over the tasks
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(spread), pa.array(np.ones(size, dtype=bool)), batch.column(0), batch.column(1), *(pa.array(c) for c in (n_words, known, base, np.ones(size, np.int64), score))],
                names=names,
            )
            row, value, n = (np.concatenate(c) if c else np.zeros(0) for c in rare)
            for a in range(0, len(row), 20_000):
                part = slice(a, a + 20_000)
                m = len(row[part])
                zero = pa.array(np.zeros(m, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[part]), pa.array(value[part].view(np.int64)), pa.array(np.zeros(m, dtype=bool)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), zero, zero, pa.array(np.zeros(m)), pa.array(n[part].astype(np.int64)), pa.array(np.zeros(m))],
                    names=names,
                )

    return encoded.select("doc_id", "fold", "text", "ids", "row").mapInArrow(run, _SCORED)


def score(docs: DataFrame, parts: int = 7, held: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``.

    doc_id; held_out; n_tokens (words and one end); n_known of them that occur
    in training; train_tokens of all training documents; base_score, the add-one
    unigram log10 probability; score, the attention model's log10 probability of
    the text. A null or empty text is its end alone. Rows with a null id train
    and are not held out; repeated rows are scored as often as they occur.
    Without training documents the counts are zero and the model is uniform.
    Other columns are not read.
    """
    path = path or default_path()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(F.col(id_col), parts).alias("fold"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    # rows are numbered in the stored table, so that every pass over it sees the same numbers
    encoded = stored(_encoded(texts, path).withColumn("row", F.monotonically_increasing_id()))
    training = encoded.where(F.col("fold") != held)
    counts = settled(_word_counts(training))
    ends = training.count()
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = (total[0] or 0) + ends, total[1] + (ends > 0)
    bottom = float(np.log10(n + v + 1))
    common = counts.where(F.col("n") >= max(1, n * FREQUENT_SHARE)).select("key", "n").toArrow()  # at most 1 / FREQUENT_SHARE rows
    key, c = common["key"].to_numpy().view(np.uint64), common["n"].to_numpy()
    order = np.argsort(key)
    frequent = key[order], np.log10(c[order] + 1.0) - bottom

    subwords = _subword_counts(training)
    subwords[END_ID] += ends
    model = _train(training, Model.start(subwords))

    found = _score(encoded, model, frequent).join(counts.withColumnRenamed("n", "c"), "key", "left")
    word = ~F.col("is_text")
    rare = F.when(word, F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - bottom)).otherwise(F.col("base"))
    known = F.when(word, F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).otherwise(F.col("known"))
    merged = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("fold").alias("fold"), F.sum("n_words").alias("n_words"), F.sum(known).alias("known"), F.sum(rare).alias("base"), F.sum("score").alias("score"))
    return merged.select(
        "doc_id",
        (F.col("fold") == held).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 1.0) - bottom)).alias("base_score"),
        "score",
    )
