"""Substring deduplication by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash of
the ``SEED_WORDS`` consecutive words inside it, so equal windows have equal
minimisers, and consecutive windows that share one form a super-k-mer. First
only the minimisers travel: one that a single document holds cannot have a
window that repeats. Of the other super-k-mers, each different one travels as
one packed string to the bucket of its minimiser, where its windows are sorted
and counted. A minimiser with many different super-k-mers gets several buckets;
its windows are counted in each and the counts of the buckets are then joined.
What comes back to a document is, for each of its super-k-mers, the windows
that a smaller id holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import settled

WINDOW = 50
SEED_WORDS = 8
#: Different super-k-mers in a bucket of a minimiser, on average, at most.
PER_BUCKET = 256

_POWER = np.uint64(0xD6E8FEB86659FD93)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _run_hash(value: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring word hashes."""
    v = words.mix(value ^ np.uint64(salt))
    out, have = v, 1
    base = _POWER
    # combine by doubling: hash(a + b) = hash(a) * base^len(b) + hash(b)
    power = {1: int(base)}
    while have < width:
        step = min(have, width - have)
        if step == have:
            out = out[:-step] * np.uint64(power[have]) + out[step:]
            power[2 * have] = power[have] ** 2 & ((1 << 64) - 1)
        else:  # the last windows overlap, which is as good a function of the words
            out = words.mix(out[:-step]) * np.uint64(power[have]) + out[step:]
        have += step
    return words.mix(out)


def super_kmers(value: np.ndarray, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer of a document's words.

    Borders also fall where the minimising place changes, so a super-k-mer has
    at most window - seed + 1 windows, however repetitive the text.
    """
    seeds = _run_hash(value, seed, 0x51)
    least = _sliding_min(seeds, window - seed + 1)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate([[0], change])
    counts = np.diff(np.concatenate([starts, [len(least)]]))
    most = window - seed + 1
    if counts.max() > most:  # a minimiser that repeats: cut its run into pieces
        pieces = -(-counts // most)
        base = np.repeat(starts, pieces)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(counts, pieces) - nth * most
        starts, counts = base + nth * most, np.minimum(left, most)
    return least[starts], starts, counts


def _documents(batch: pa.RecordBatch, id_column: int, text_column: int):
    """(row, id, words' hashes, first and last byte of each word, bytes) of each document of a batch."""
    ids = batch.column(id_column).to_pylist()
    for i, j, found in words.word_blocks(batch.column(text_column), lower=False):
        for row in range(i, j):
            a, b = found.first[row - i], found.first[row - i + 1]
            yield row, ids[row], found.value[a:b], found.begin[a:b], found.end[a:b], found.data


KMERS = "minimiser long, packed_a long, packed_b long, doc_id long, start int, n_windows int"


def _kmers(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for _, doc_id, value, *_ in _documents(batch, 0, 1):
                if len(value) < window or doc_id is None:
                    continue
                least, starts, counts = super_kmers(value, window, seed)
                ends = starts + counts + window - 1
                # two independent hashes of the packed words, from running sums
                for column, salt in ((1, 0xA1), (2, 0xB2)):
                    mixed = words.mix(value ^ np.uint64(salt))
                    powers = np.ones(len(value) + 1, dtype=np.uint64)
                    powers[1:] = _POWER + np.uint64(2 * salt)
                    np.multiply.accumulate(powers, out=powers)
                    # Horner from the back, so that equal words give equal hashes wherever they stand
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:-1])])
                    inverse = np.uint64(pow(int(_POWER + np.uint64(2 * salt)), -1, 1 << 64))
                    back = np.full(len(value) + 1, inverse, dtype=np.uint64)
                    back[0] = 1
                    np.multiply.accumulate(back, out=back)
                    out[column].append(words.mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)))
                out[0].append(least)
                out[3].append(np.full(len(starts), doc_id))
                out[4].append(starts)
                out[5].append(counts)
            if not out[0]:
                continue
            kinds = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]
            arrays = [np.concatenate(c) for c in out]
            arrays = [a.view(np.int64) if a.dtype == np.uint64 else a.astype(k) for a, k in zip(arrays, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[c.split()[0] for c in KMERS.split(", ")])

    return docs.mapInArrow(run, KMERS)


PACKED = "minimiser long, salt int, crowded boolean, packed_a long, packed_b long, least_id long, packed binary"


def _pack(joined: DataFrame, window: int) -> DataFrame:
    """The packed strings of the super-k-mers listed in ``wanted`` of each document."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for row, doc_id, _, begin, end, data in _documents(batch, 0, 1):
                for k in wanted[row]:
                    first = k["start"]
                    last = first + k["n_windows"] + window - 2
                    pieces = [data[begin[w] : end[w]].tobytes() for w in range(first, last + 1)]
                    for column, item in zip(out, (k["minimiser"], k["salt"], k["buckets"] > 1, k["packed_a"], k["packed_b"], doc_id, b" ".join(pieces)), strict=True):
                        column.append(item)
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

    return joined.mapInArrow(run, PACKED)


COUNTED = "packed_a long, packed_b long, place int, window_a long, window_b long, least_id long, own_id long, crowded boolean"


def _count_bucket(rows: dict[str, np.ndarray], window: int) -> list[np.ndarray]:
    """Sorts the windows of whole buckets and finds the smallest id with each window: columns of ``COUNTED``.

    A packed string's own smallest id holds all its windows, so only windows
    with a smaller one are told, and all windows of crowded minimisers.
    """
    raw = [p + b" " for p in rows["packed"]]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = words.split(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, lower=False)
    n = np.diff(found.first) - window + 1
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = found.first[:-1][owner] + place
    a, b = (_run_hash(found.value, window, salt)[at] for salt in (0xC3, 0xD4))
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    least = np.minimum.reduceat(rows["least_id"][owner][order], np.flatnonzero(new))
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    columns = [rows["packed_a"][owner], rows["packed_b"][owner], place.astype(np.int32), a.view(np.int64), b.view(np.int64), least[of], rows["least_id"][owner], rows["crowded"][owner]]
    told = np.flatnonzero(columns[7] | (columns[5] < columns[6]))
    return [c[told] for c in columns]


def _bucket_counts(packed: DataFrame, window: int) -> DataFrame:
    """The windows that :func:`_count_bucket` tells, of all buckets."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            table = pa.Table.from_batches(held)
            rows = {c: table[c].to_numpy() for c in ("packed_a", "packed_b", "least_id", "crowded")} | {"packed": table["packed"].to_pylist()}
            columns = _count_bucket(rows, window)
            for at in range(0, len(columns[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000]) for c in columns], names=[c.split()[0] for c in COUNTED.split(", ")])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            # whole buckets are counted together, as windows of different minimisers never are equal
            last = cuts[-2]
            if tuple(keys[:, 0]) != key and held and sum(b.num_rows for b in held) >= 4 * PER_BUCKET:
                yield from flush()
                held = []
            if last:
                held.append(batch.slice(0, last))
                yield from flush()
                held = []
            held.append(batch.slice(last))
            key = tuple(keys[:, -1])
        if held:
            yield from flush()

    return packed.repartition("minimiser", "salt").sortWithinPartitions("minimiser", "salt").mapInArrow(run, COUNTED)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(joined: DataFrame, window: int, with_text: bool) -> DataFrame:
    schema = RESULT + (", kept_text string" if with_text else "")

    def run(batches):
        for batch in batches:
            found = batch.column(2).to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for row, doc_id, value, begin, end, data in _documents(batch, 0, 1):
                keep = np.ones(len(value), dtype=bool)
                if found[row]:
                    edge = np.zeros(len(value) + 1, dtype=np.int64)
                    for k in found[row]:
                        if k["least_id"] < doc_id:  # all windows of the super-k-mer
                            edge[k["start"]] += 1
                            edge[k["start"] + k["n_windows"] + window - 1] -= 1
                            continue
                        for w in k["windows"] or ():
                            if w["least"] < doc_id:
                                edge[k["start"] + w["place"]] += 1
                                edge[k["start"] + w["place"] + window] -= 1
                    keep = np.cumsum(edge)[:-1] == 0
                kept = b" ".join([data[a:b].tobytes() for a, b in zip(begin[keep], end[keep], strict=True)])
                for column, item in zip(out, (doc_id, len(value), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    column.append(item)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            n = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds, strict=False)], names=[c.split()[0] for c in schema.split(", ")])

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, per_bucket: int = PER_BUCKET, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of ``docs``.

    Removed is every word covered by a window that also starts in a document
    with a smaller id. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null or
    empty text has no words, a text shorter than the window loses none. Rows
    with equal ids are one document for the comparison. A row with a null id
    loses no words and takes none from others. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kmers = _kmers(texts, window, seed)
    several = kmers.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser")
    shared = settled(kmers.join(several, "minimiser", "left_semi"))

    # each different super-k-mer once, from the document with the smallest id
    key = ["minimiser", "packed_a", "packed_b"]
    different = settled(shared.groupBy(key).agg(F.min(F.struct("doc_id", "start", "n_windows")).alias("from")))
    crowd = different.groupBy("minimiser").agg(F.ceil(F.count(F.lit(1)) / per_bucket).cast("int").alias("buckets"))
    dealt = different.join(crowd, "minimiser").withColumn("salt", F.pmod("packed_a", F.col("buckets")).cast("int"))
    wanted = dealt.groupBy(F.col("from.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("minimiser", "salt", "buckets", "packed_a", "packed_b", F.col("from.start").alias("start"), F.col("from.n_windows").alias("n_windows"))).alias("wanted")
    )
    bodies = words.squeeze(texts)
    one_text = bodies.where("doc_id IS NOT NULL").join(wanted, "doc_id").select("doc_id", "body", "wanted")
    counted = settled(_bucket_counts(_pack(one_text, window), window))

    # windows of a crowded minimiser: the smallest id over its buckets
    crowded = counted.where("crowded")
    over_all = crowded.groupBy("window_a", "window_b").agg(F.min("least_id").alias("least"))
    crowded = crowded.select("packed_a", "packed_b", "place", "window_a", "window_b", "own_id").join(over_all, ["window_a", "window_b"])
    told = counted.where("NOT crowded").withColumn("least", F.col("least_id"))
    columns = ["packed_a", "packed_b", "place", "least"]
    told = told.select(columns).unionByName(crowded.where("least < own_id").select(columns))
    told = told.groupBy("packed_a", "packed_b").agg(F.collect_set(F.struct("place", "least")).alias("windows"))

    owners = different.select(*key, F.col("from.doc_id").alias("least_id"))
    places = shared.join(owners, key).join(told, ["packed_a", "packed_b"], "left").where("doc_id > least_id OR windows IS NOT NULL")
    found = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_windows", "least_id", "windows")).alias("found"))
    return _finish(bodies.join(found, "doc_id", "left").select("doc_id", "body", "found"), window, with_text)
