"""Phrase collocations by growing contiguous patterns to the right.

Four passes over the texts, none of which moves a text:

1. words are counted;
2. pairs of neighbouring frequent words are counted by their hash;
3. so are triples of two frequent pairs;
4. every place where a frequent pair begins is a pointer: the words from there on,
   as far as each triple is frequent, ``most_words`` at most. Equal pointers are
   counted together before they are shuffled.

Then patterns grow: the pointers of one prefix meet in one task, which projects
them on each next word and goes on, depth first, as long as a pattern is frequent
enough. A prefix with more than ``SPLIT`` different pointers is counted by Spark
and dealt out by its longer prefixes.

What is frequent is told to the tasks of the next pass by bitmaps of a bounded
size. A bit that is set for something rare only lets it through: the exact
counts of the patterns decide, so no result depends on a bitmap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .common import MOST_IDS, settled, small_batches

LEAST = 100
MOST_WORDS = 5
TOP = 2000
UNKNOWN = "und"
#: Different pointers of a prefix that one task takes.
SPLIT = 200_000
#: Bits of a bitmap: 16 for each entry, as a power of two within these.
LEAST_BITS, MOST_BITS = 15, 27
#: Parts that a language's best phrases are first looked for in.
RANK_PARTS = 32

_WORD, _GAP, _CUT = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _then(before: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The hash of a pattern and the word after it."""
    return words.mix(before * _STEP + following)


def _chosen(data: np.ndarray, begin: np.ndarray, end: np.ndarray, last: np.ndarray, strings: int) -> pa.Array:
    """The byte ranges as strings: ranges of one string are joined by a space, ``last`` marks the last one of each."""
    length = end - begin + ~last
    stop = np.cumsum(length)
    source = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - length), length)
    out = data[np.minimum(source, max(len(data) - 1, 0))]
    out[(stop - 1)[~last]] = 0x20
    offsets = np.concatenate([[0], stop[last]]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(strings, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


class Pieces:
    """The words of a block of texts: where they are, their hashes with their language, and whether a word follows the one before it within a piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, language: np.ndarray):
        self.data = data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == _WORD
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        border = np.asarray(bounds[1:-1])
        border = border[(border > 0) & (border < len(data))]
        split = np.unique(border[inside[border] & inside[border - 1]])  # a text may end, and the next begin, inside a word
        if len(split):
            begin, end = np.sort(np.concatenate([begin, split])), np.sort(np.concatenate([end, split]))
        self.begin, self.end = begin, end
        self.row = np.searchsorted(bounds, begin, side="right") - 1
        self.value = words.mix(words.hashes(data, begin, end) ^ language[self.row]) if len(begin) else np.zeros(0, np.uint64)
        self.follows = np.zeros(len(begin), dtype=bool)
        if len(begin):
            cuts = np.cumsum(kind == _CUT)
            self.follows[1:] = (cuts[begin[1:]] == cuts[end[:-1] - 1]) & (self.row[1:] == self.row[:-1])


def _pieces(batch: pa.RecordBatch):
    """The words of each block of a batch (lang, text), and the language of its rows."""
    lang = batch.column(0).cast(pa.string()).dictionary_encode()
    names = [n.as_py() for n in lang.dictionary]
    raw = [n.encode() for n in names]
    stop = np.cumsum([len(r) + 1 for r in raw])
    code = lang.indices.to_numpy(zero_copy_only=False)
    salt = words.hashes(np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8), np.concatenate([[0], stop[:-1]]).astype(np.int64), stop) if names else np.zeros(0, np.uint64)
    for i, j, data, bounds in words.blocks(batch.column(1)):
        yield Pieces(data, bounds, salt[code[i:j]]), code[i:j], names


def _languages(names: list[str], code: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())


def _word_counts(batches):
    """(lang, word, n) of the different words of a block; a null word stands for all words of the language."""
    for batch in batches:
        for found, code, names in _pieces(batch):
            _, which, n = np.unique(found.value, return_index=True, return_counts=True)
            texts = _chosen(found.data, found.begin[which], found.end[which], np.ones(len(which), dtype=bool), len(which))
            yield pa.RecordBatch.from_arrays([_languages(names, code[found.row[which]]), texts, pa.array(n)], names=["lang", "word", "n"])
            total = np.bincount(code[found.row], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(total)], names=["lang", "word", "n"])


class Bitmap:
    """Which hashes may be frequent; its size is a power of two, whatever the number of entries."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, value: np.ndarray) -> np.ndarray:
        bit = value >> np.uint64(64 - self.bits)
        return (self.data[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, column: str, n: int) -> Bitmap:
    """The bitmap of ``n`` 64-bit hashes, put together by Spark and at most 2**MOST_BITS bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n - 1).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bytes")).collect()
    data = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        part = np.frombuffer(bytes(r["bytes"]), dtype=np.uint8)[: len(data) - at]
        data[at : at + len(part)] = part
    return Bitmap(bits, data)


def _hashed(batches):
    """The hash of each (lang, word), as texts have it."""
    for batch in batches:
        for found, _, _ in _pieces(batch):
            yield pa.RecordBatch.from_arrays([pa.array(found.value.view(np.int64))], names=["value"])


def _links(found: Pieces, known: Bitmap, pairs: Bitmap | None, room: int) -> np.ndarray:
    """Whether each word follows one with which it may be a frequent pair (without ``pairs``: two frequent words); ``room`` more places follow the last."""
    some = known.has(found.value)
    link = np.zeros(len(found.value) + room, dtype=bool)
    at = np.flatnonzero(found.follows[1:] & some[1:] & some[:-1]) + 1
    link[at] = True if pairs is None else pairs.has(_then(found.value[at - 1], found.value[at]))
    return link


def _hashed_at(value: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each of the places ``start``."""
    out = value[start]
    for k in range(1, length):
        out = _then(out, value[start + k])
    return out


def _pattern_counts(frequent, pairs):
    """(pattern, n): pairs of words that may be frequent or, with ``pairs``, triples of pairs that may be, by their hash."""

    def run(batches):
        known, linked, length = frequent.value, pairs and pairs.value, 3 if pairs else 2
        for batch in batches:
            for found, _, _ in _pieces(batch):
                link = _links(found, known, linked, 1)
                at = np.flatnonzero(link[1:-1] & link[2:] if pairs else link[1:-1])
                pattern, n = np.unique(_hashed_at(found.value, at, length), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern.view(np.int64)), pa.array(n)], names=["pattern", "n"])

    return run


def _pointers(frequent, pairs, triples, most_words: int):
    """(lang, phrase, n): from each place where a pair that may be frequent begins, the words up to the first triple that is not."""

    def run(batches):
        known, linked, going_on = frequent.value, pairs.value, triples.value
        for batch in batches:
            for found, code, names in _pieces(batch):
                link = _links(found, known, linked, most_words)
                third = np.zeros(len(link), dtype=bool)  # whether a word ends a triple
                at = np.flatnonzero(link[1:-1] & link[2:])
                third[at + 2] = going_on.has(_hashed_at(found.value, at, 3))
                start = np.flatnonzero(link[1:])
                length, on, value = np.full(len(start), 2), np.ones(len(start), dtype=bool), _hashed_at(found.value, start, 2)
                for k in range(2, most_words):
                    on &= third[start + k]
                    value[on] = _then(value[on], found.value[(start + k)[on]])
                    length += on
                # the length is mixed in, so that a pointer is no shorter one's equal
                _, which, n = np.unique(words.mix(value + length.astype(np.uint64)), return_index=True, return_counts=True)
                start, length = start[which], length[which]
                stop = np.cumsum(length)
                word = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)
                last = np.zeros(len(word), dtype=bool)
                last[stop - 1] = True
                texts = _chosen(found.data, found.begin[word], found.end[word], last, len(start))
                yield pa.RecordBatch.from_arrays([_languages(names, code[found.row[start]]), texts, pa.array(n)], names=["lang", "phrase", "n"])

    return run


def grown(pointers: list[int], phrase: list[list[str]], n: list[int], depth: int, least: int):
    """(words, occurrences) of the frequent patterns that go on after the first ``depth`` words of these pointers, depth first."""
    following: dict[str, list[int]] = {}
    for p in pointers:
        if len(phrase[p]) > depth:
            following.setdefault(phrase[p][depth], []).append(p)
    for word in sorted(following):
        found = following[word]
        total = sum(n[p] for p in found)
        if total >= least:
            yield phrase[found[0]][: depth + 1], total
            yield from grown(found, phrase, n, depth + 1, least)


def _grow(least: int):
    """Patterns of each prefix; the rows of a prefix stand together."""

    def patterns(rows):
        lang, depth = rows[0][:2]
        phrase, n = [r[2] for r in rows], [r[3] for r in rows]
        if sum(n) >= least:
            yield lang, phrase[0][:depth], sum(n)
            for found, total in grown(list(range(len(rows))), phrase, n, depth, least):
                yield lang, found, total

    def run(batches):
        rows: list[tuple] = []
        key = None

        def made(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.int64())],
                names=["lang", "words", "a"],
            )

        for batch in batches:
            out = []
            for lang, depth, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                phrase = text.split(" ")
                now = (lang, depth, phrase[:depth])
                if now != key and rows:
                    out += patterns(rows)
                    rows = []
                key = now
                rows.append((lang, depth, phrase, n))
            yield made(out)
        if rows:
            yield made(list(patterns(rows)))

    return run


def _dealt(pointers: DataFrame, least: int, most_words: int) -> tuple[DataFrame, DataFrame]:
    """The pointers with ``depth``, the words that name their task, and the patterns that Spark counts since they are prefixes with many pointers."""
    out = pointers.withColumn("depth", F.lit(2))
    counted = pointers.sparkSession.createDataFrame([], "lang string, words array<string>, a long")
    for depth in range(2, most_words):
        prefix = F.substring_index("phrase", " ", depth)
        sizes = out.where(F.col("depth") == depth).groupBy("lang", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("pointers"), F.sum("n").alias("a"))
        hot = settled(sizes.where(F.col("pointers") > SPLIT).select("lang", "prefix", "a"))
        many = hot.count()
        if many == 0:
            break
        counted = counted.unionByName(hot.where(F.col("a") >= least).select("lang", F.split("prefix", " ").alias("words"), "a"))
        keys = hot.select(F.col("lang").alias("hot_lang"), F.col("prefix").alias("hot_prefix"))
        keys = F.broadcast(keys) if many <= MOST_IDS else keys
        met = out.join(keys, (F.col("depth") == depth) & (F.col("lang") == F.col("hot_lang")) & (prefix == F.col("hot_prefix")), "left")
        out = met.where(F.col("hot_lang").isNull() | (F.col("phrase") != prefix)).withColumn("depth", F.when(F.col("hot_lang").isNull(), F.col("depth")).otherwise(depth + 1)).drop("hot_lang", "hot_prefix")
    return out, counted


def _bitmap_of_patterns(texts: DataFrame, least: int, frequent, pairs):
    patterns = texts.mapInArrow(_pattern_counts(frequent, pairs), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = settled(patterns.where(F.col("n") >= least).select("pattern"))
    return texts.sparkSession.sparkContext.broadcast(bitmap(patterns, "pattern", patterns.count()))


def frequent_patterns(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, words, a) of the frequent phrases of 2 words or more, (lang, word, n) of the frequent words, and (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = settled(counts.where((F.col("n") >= least) | F.col("word").isNull()))
    totals, known = counts.where("word IS NULL").select("lang", "n"), counts.where("word IS NOT NULL")

    hashed = known.select("lang", "word").mapInArrow(_hashed, "value long")
    frequent = spark.sparkContext.broadcast(bitmap(hashed, "value", known.count()))
    pairs = _bitmap_of_patterns(texts, least, frequent, None)
    triples = _bitmap_of_patterns(texts, least, frequent, pairs)

    pointers = texts.mapInArrow(_pointers(frequent, pairs, triples, most_words), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    dealt, counted = _dealt(settled(pointers), least, most_words)
    prefix = F.expr("substring_index(phrase, ' ', depth)")
    tasks = dealt.repartition("lang", prefix).sortWithinPartitions("lang", "depth", prefix).select("lang", "depth", "phrase", "n")
    found = tasks.mapInArrow(_grow(least), "lang string, words array<string>, a long").unionByName(counted)
    return settled(found), known, totals


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    Letters A-Z are lower-cased, texts are split into pieces at ``.,;:!?`` and
    line ends, and pieces into words at spaces and tabs. Per language ``n`` counts
    all words; phrases of 2 to ``most_words`` words with ``a >= least`` occurrences
    (overlapping ones included) are candidates. A candidate is cut after its first
    words where ``floor(1000 a n / (l r))`` is lowest, of equal ones after the
    fewest words, with the occurrences ``l`` and ``r`` of the two parts. A
    candidate inside a longer one with as many occurrences is dropped. The order
    is by score and ``a``, descending, and by the bytes of the phrase.

    A null text is empty, a null language is ``und``. Repeated rows count as
    often as they stand there; ids are not read, nor are columns of other names.
    A very long text is one block of words. An empty table gives no rows. Words
    of one block of texts are told apart by 64-bit hashes, all others by their
    characters. Scores are exact up to 10**15 occurrences.
    """
    found, known, totals = frequent_patterns(docs, least, most_words)
    counts = known.select("lang", F.array("word").alias("words"), F.col("n").alias("a")).unionByName(found)
    size = F.size("words")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left_words"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right_words")
    )
    cuts = cuts.join(counts.select("lang", F.col("words").alias("left_words"), F.col("a").alias("l")), ["lang", "left_words"])
    cuts = cuts.join(counts.select("lang", F.col("words").alias("right_words"), F.col("a").alias("r")), ["lang", "right_words"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= MOST_IDS else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("thousand", F.lit(1000) * F.col("a")).withColumns({"top": wide("thousand") * wide("n"), "below": wide("l") * wide("r")})
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct(F.expr("`top` DIV below").alias("score"), "k", "a", "l", "r", "n")).alias("b"))

    longer = found.where(size > 2)
    parts = longer.select("lang", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), "a")
    inside = parts.groupBy("lang", "words").agg(F.max("a").alias("around"))
    left = best.join(inside, ["lang", "words"], "left").where("around IS NULL OR around < b.a")
    rows = left.select("lang", F.array_join("words", " ").alias("phrase"), "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
