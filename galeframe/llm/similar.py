"""Exact n-gram Jaccard join by count vectors in an R-tree.

A document is the set of its word shingles. Shingles are hashed into groups and
the document is the point of its group counts; two documents share at most the
sum of the smaller counts, coordinate by coordinate, which bounds their overlap.

The index has two levels. The upper level is a partitioning that Spark deals
out: the hash range is cut into so many slabs that two documents similar enough
must agree on all of some slab that is not empty (their sets differ in fewer
shingles than there are slabs). Documents that agree on a slab stand together,
are put into an R-tree of their count vectors, and those whose bound reaches the
threshold are connected; what is connected that way is a family, and no link
ever leaves its family. The lower level is an R-tree over a block of a family:
boxes, then points, are compared by the bound, and the pairs that survive it are
verified on the sets themselves.

Equal sets are linked first and go on as one. A family of many documents is
split into blocks; each is linked within itself, then a few documents of every
block and group meet in new blocks until they fit into one. A family that is one
group by then is done, and its cost is a few sets a document. Where groups are
left, every document outside the family's largest group is compared with all
documents of other groups, block by block, which no link escapes.
"""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .common import MOST_IDS, counted, small_batches, stored, without_keys
from .components import components, forest

#: Coordinates of a point, at least, and the mean count in a coordinate, at most.
GROUPS = 64
MEAN_COUNT = 16
#: Documents of a slab that are held at once; a larger slab is connected without looking at its points.
MOST_HELD = 4096
#: Low bits of a slab key that hold its band.
BAND_BITS = 6
#: Points in a leaf of the R-tree.
LEAF = 16
#: Documents, and shingles in thousands, in a block of a family on average.
BLOCK_DOCS = 256
BLOCK_SHINGLES = 1000
#: Sizes from one to this many times as large share the same slabs.
BAND = 1.5
#: Documents of a block and group that meet those of other blocks.
SPOKESMEN = 8
#: Families' documents that are broadcast to fetch their texts, at most; more are shuffled.
MOST_PLACED = 200_000


def shingle_sets(column: pa.Array, n: int):
    """(row, sorted distinct 64-bit shingles) of each text; fewer than n words are one shingle, no words none."""
    for i, j, found in words.word_blocks(column, lower=True):
        value = found.value
        run = words.mix(value)
        for k in range(1, n):
            run = words.mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + words.mix(value[k:] ^ np.uint64(k))) if len(run) > 1 else run[:0]
        for row in range(i, j):
            a, b = found.first[row - i], found.first[row - i + 1]
            if b - a >= n:
                yield row, np.unique(run[a : b - n + 1])
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    short = words.mix(short * np.uint64(0x9E3779B97F4A7C15) + value[k : k + 1])
                yield row, short
            else:
                yield row, np.zeros(0, dtype=np.uint64)


def _band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


@functools.cache
def band_top(band: int) -> int:
    """The largest set size of a band."""
    n = int(BAND ** (band + 1)) + 2
    while _band(np.array([n]))[0] > band:
        n -= 1
    return n


@functools.cache
def slab_plan(band: int, threshold: Fraction) -> tuple[int, int]:
    """(slabs, most differing shingles) of a band.

    Two sets of sizes a, b with similarity t or more differ in at most
    (a + b)(1 - t) / (1 + t) shingles. Beyond one slab more than that there are
    spare ones, so that some agreeing slab holds a shingle.
    """
    differ = int(2 * band_top(band) * (1 - threshold) / (1 + threshold))
    return differ + 1 + (0 if differ == 0 else max(1, differ // 20)), differ


def slab_keys(shingles: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Keys of a set's slabs, in its own band and in every higher one that a similar set may be in."""
    return spared_keys(shingles, threshold)[0]


def spared_keys(shingles: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, list[int]]:
    """The keys of :func:`slab_keys`, and of each band from the lowest how many of them may go.

    A set of n shingles and one like it differ in at most (n + m)(1 - t) / (1 + t)
    shingles, m being the largest size of those like it in the band, and share all
    other slabs. Without slabs that are empty here they still share one key more
    than may go.
    """
    n = len(shingles)
    lowest, highest = _band(np.array([n, int(n / threshold)])).tolist()
    mixed = words.mix(shingles ^ np.uint64(0x5AB5))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
    high = shingles >> np.uint64(32)
    out, spare = [], []
    for level in range(lowest, highest + 1):
        slabs, _ = slab_plan(level, threshold)
        slab = (high * np.uint64(slabs)) >> np.uint64(32)  # rises with the sorted shingles
        edges = np.searchsorted(slab, np.arange(slabs + 1).astype(np.uint64))
        number = np.arange(slabs)
        held = edges[1:] > edges[:-1]
        differ = int((n + min(band_top(level), int(n / threshold))) * (1 - threshold) / (1 + threshold))
        may_go = int(held.sum()) - differ - 1
        if may_go >= 0:  # fewer empty slabs than agreeing ones
            number = number[held]
        spare.append(max(0, may_go))
        total = sums[edges[number + 1]] - sums[edges[number]]
        key = words.mix(total ^ words.mix(number.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(level + 1)))
        out.append((key & ~np.uint64((1 << BAND_BITS) - 1)) | np.uint64(level))
    return np.concatenate(out), spare


@functools.cache
def coordinates(band: int) -> int:
    """A power of two, so that a point of more coordinates can be folded."""
    groups = GROUPS
    while band_top(band) > MEAN_COUNT * groups:
        groups *= 2
    return groups


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((words.mix(shingles) & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def point_of(stored: bytes, groups: int) -> np.ndarray:
    """A stored point, folded; a count of 255 stands for any larger one and never lowers a bound."""
    point = np.frombuffer(stored, dtype=np.uint8).astype(np.int32)
    if b"\xff" in stored:
        point[point == 255] = 1_000_000
    return point if len(point) == groups else point.reshape(-1, groups).sum(axis=0)


def _whole(shingles: np.ndarray) -> np.uint64:
    """A hash of the whole set."""
    return words.mix(np.array([words.mix(shingles).sum() ^ np.uint64(len(shingles))]))[0]


def _facts(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(doc_id, n_shingles, set_key, point, keys, lowest, spare): the size of each set, a hash of it, its point with counts of 255 for more, its slabs, and from its lowest band how many of them may go."""

    def run(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, dtype=np.int64)
            key = np.zeros(batch.num_rows, dtype=np.uint64)
            points = [b""] * batch.num_rows
            keys = [np.zeros(0, np.int64)] * batch.num_rows
            lowest, spare = np.zeros(batch.num_rows, dtype=np.int32), [[]] * batch.num_rows
            for row, s in shingle_sets(batch.column(1), n):
                size[row], key[row] = len(s), _whole(s)
                groups = coordinates(int(_band(np.array([len(s) / threshold]).astype(float))[0]))
                points[row] = np.minimum(count_vector(s, groups), 255).astype(np.uint8).tobytes()
                if len(s):
                    found, spare[row] = spared_keys(s, threshold)
                    keys[row], lowest[row] = found.view(np.int64), _band(np.array([len(s)]))[0]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            columns = [batch.column(0), pa.array(size), pa.array(key.view(np.int64)), pa.array(points, pa.binary()), lists, pa.array(lowest), pa.array(spare, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "point", "keys", "lowest", "spare"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key long, point binary, keys array<long>, lowest int, spare array<int>")


def _members(alone: DataFrame) -> DataFrame:
    """(key, doc_id, n_shingles, point): the documents that stand together, where each has given up as many of its most shared slabs as it may.

    Two similar documents share more slabs than either gives up. All give up
    slabs in one order, so the rarest they share stays with both. Slabs of the
    same documents stand together once, which for near copies is nearly all.
    """
    of_slab = Window.partitionBy("key")
    told = {"m": F.count(F.lit(1)), "x": F.min("doc_id"), "y": F.max("doc_id"), "z": F.bit_xor("doc_id")}  # of the id itself: nothing else is shuffled
    slabs = alone.select("doc_id", F.explode("keys").alias("key")).select("doc_id", "key", *(value.over(of_slab).alias(name) for name, value in told.items())).where("m > 1")
    band = (1 << BAND_BITS) - 1
    slabs = slabs.select("doc_id", F.expr(f"xxhash64(m, x, y, z) & ~{band}L | key & {band}L").alias("key"), "m").repartition("doc_id")
    times = slabs.groupBy("doc_id", "key", "m").agg(F.count(F.lit(1)).alias("times"))
    of_doc = Window.partitionBy("doc_id", "band").orderBy(F.desc("m"), "key").rowsBetween(Window.unboundedPreceding, 0)
    times = times.join(alone.select("doc_id", "lowest", "spare"), "doc_id").withColumn("band", F.expr(f"CAST(key & {band}L AS INT)"))
    kept = times.withColumn("gone", F.sum("times").over(of_doc)).where("gone > get(spare, band - lowest)").select("doc_id", "key")
    return kept.join(alone.select("doc_id", "n_shingles", "point"), "doc_id").select("key", "doc_id", "n_shingles", "point")


# --- the R-tree of one block or pair of blocks


class RTree:
    """Points packed into leaves in the order of their sizes and first coordinates; each leaf has its box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(points), LEAF)
        self.starts = starts
        self.high = np.maximum.reduceat(self.points, starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, starts)
        self.most = np.maximum.reduceat(self.sizes, starts)

    def candidates(self, point: np.ndarray, size: int, rate: Fraction, apart: np.ndarray) -> np.ndarray:
        """Numbers of the points in ``apart`` (a mask) whose overlap with ``point`` may reach ``rate`` times both sizes."""
        least = -(-rate.numerator * (size + self.least) // rate.denominator)
        leaves = np.flatnonzero((np.minimum(self.high, point).sum(axis=1) >= least) & (np.minimum(self.most, size) >= least))
        if not len(leaves):
            return np.zeros(0, dtype=np.int64)
        at = (self.starts[leaves][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        at = at[apart[self.order[at]]]
        need = -(-rate.numerator * (size + self.sizes[at]) // rate.denominator)
        return self.order[at[np.minimum(self.points[at], point).sum(axis=1) >= need]]


class Groups:
    """Which points are connected so far: a label each."""

    def __init__(self, label: np.ndarray):
        different, self.label = np.unique(label, return_inverse=True)
        self.left = len(different)

    def apart(self, x: int) -> np.ndarray:
        return self.label != self.label[x]

    def connect(self, x: int, y: int) -> None:
        self.label[self.label == self.label[y]] = self.label[x]
        self.left -= 1


def linked_pairs(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: Fraction, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the threshold connects: at most one fewer than there are documents.

    With ``side``, only pairs of different sides are looked at; with ``label``,
    only documents that it does not connect already.
    """
    rate = threshold / (1 + threshold)  # overlap >= rate * (a + b) is similarity >= threshold
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    groups = coordinates(int(_band(sizes.max())))
    points = np.stack([count_vector(s, groups) for s in sets])
    stored = np.arange(len(ids)) if side is None else np.flatnonzero(side == 1)
    asking = np.arange(len(ids)) if side is None else np.flatnonzero(side == 0)
    if not len(stored) or not len(asking):
        return []
    tree = RTree(points[stored], sizes[stored])
    known = Groups(np.arange(len(ids)) if label is None else label)
    out = []
    for q in asking.tolist():
        if known.left == 1:
            break
        for c in stored[tree.candidates(points[q], int(sizes[q]), rate, known.apart(q)[stored])].tolist():
            if known.label[c] == known.label[q]:
                continue
            both = len(np.intersect1d(sets[q], sets[c], assume_unique=True))
            if rate.denominator * both >= rate.numerator * int(sizes[q] + sizes[c]):
                known.connect(q, c)
                out.append((int(ids[q]), int(ids[c])))
    return out


def near_pairs(points: np.ndarray, sizes: np.ndarray, rate: Fraction) -> list[tuple[int, int]]:
    """Pairs that connect all points whose overlap, by the bound, may reach the threshold."""
    tree = RTree(points, sizes)
    known = Groups(np.arange(len(points)))
    out = []
    for q in range(len(points)):
        if known.left == 1:
            break
        for c in tree.candidates(points[q], int(sizes[q]), rate, known.apart(q)).tolist():
            if known.label[c] != known.label[q]:
                known.connect(q, c)
                out.append((q, c))
    return out


def _near(members: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): documents of a slab that the bound connects, reduced by task; rows of a slab stand together."""
    rate = threshold / (1 + threshold)

    def run(batches):
        key, ids, sizes, points, whole = None, [], [], [], False
        out: list[tuple[int, int]] = []

        def finish():
            if whole:  # too many to hold: all of them are connected, which loses no link
                out.extend((ids[0], i) for i in ids[1:])
            elif len(ids) > 1:
                width = coordinates(key & ((1 << BAND_BITS) - 1))
                held = [point_of(p, width) for p in points]
                if len(ids) == 2:
                    near = rate.denominator * int(np.minimum(*held).sum()) >= rate.numerator * sum(sizes)
                    pairs = [(0, 1)] if near else []
                else:
                    pairs = near_pairs(np.stack(held), np.array(sizes), rate)
                out.extend((ids[a], ids[b]) for a, b in pairs if ids[a] != ids[b])

        def batch_out():
            done = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out.clear()
            return done

        for batch in batches:
            for k, doc_id, size, point in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != key:
                    finish()
                    key, ids, sizes, points, whole = k, [], [], [], False
                ids.append(doc_id)
                sizes.append(size)
                points.append(point)
                if len(ids) > MOST_HELD:
                    whole = True
                    out.extend((ids[0], i) for i in ids[1:])
                    ids, sizes, points = ids[:1], sizes[:1], points[:1]
            yield batch_out()
        finish()
        yield batch_out()

    return members.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(lambda batches: forest(run(batches)), "id long, component long").toDF("a", "b")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """The rows with the compressed text replaced by the set; all other columns stay."""
    columns = [c for c in docs.columns if c != "body"]
    schema = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in columns) + ", shingles binary"

    def run(batches):
        for batch in batches:
            sets = [b""] * batch.num_rows
            for row, s in shingle_sets(batch.column(batch.schema.get_field_index("body")), n):
                sets[row] = s.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sets, pa.binary())], names=[*columns, "shingles"])

    return docs.mapInArrow(run, schema)


PLACED = ["family", "i", "j", "side", "doc_id", "label", "shingles"]


def _verified(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): links within each (family, i, j), reduced by task; where j is not -1, only those of side 1 with side 0."""

    def run(batches):
        key, ids, sides, labels, sets, out = None, [], [], [], [], []

        def finish():
            if len(ids) > 1:
                whole = key[2] == -1
                out.extend(linked_pairs(np.array(ids), sets, None if whole else np.array(sides), threshold, np.array(labels)))

        def batch_out():
            done = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out.clear()
            return done

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for family, i, j, side, doc_id, label, raw in zip(*columns, batch.column(6), strict=True):
                if (family, i, j) != key:
                    finish()
                    key, ids, sides, labels, sets = (family, i, j), [], [], [], []
                ids.append(doc_id)
                sides.append(side)
                labels.append(label)
                sets.append(np.frombuffer(raw.as_py(), dtype=np.uint64))
            yield batch_out()
        finish()
        yield batch_out()

    together = rows.select(PLACED).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "doc_id")
    return together.mapInArrow(lambda batches: forest(run(batches)), "id long, component long").toDF("a", "b")


def _sets_of(texts: DataFrame, placed: DataFrame, size: int, n: int) -> DataFrame:
    """``placed``, of ``size`` rows, with the sets of its documents; texts move only where their documents are too many to be broadcast."""
    if size <= MOST_PLACED:
        return _sets(texts.join(F.broadcast(placed), "doc_id").select(*placed.columns, F.col("text").alias("body")), n)
    return _sets(words.squeeze(texts).join(placed, "doc_id").select(*placed.columns, "body"), n)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the label of each document: the smallest id that links reach."""
    return rows.drop("label").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def _as_links(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _block(n, salt: int = 0):
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), n).cast("int")


def _links_of_large(large: DataFrame, threshold: Fraction, block_docs: int) -> DataFrame:
    """Links of families of several blocks: (doc_id, family, blocks, shingles) rows of whole families."""
    # each block within itself
    rows = large.withColumn("i", _block(F.col("blocks"))).withColumns({"j": F.lit(-1), "side": F.lit(0), "label": F.col("doc_id")})
    found = components(_verified(rows, threshold), reduced=True)

    # a few documents of every block and group meet in new blocks, fewer each time
    level, met, size = 0, rows, None
    while True:
        first = Window.partitionBy("family", "i", "label").orderBy(F.xxhash64("doc_id", F.lit(-1)), "doc_id")
        some = _labelled(met, found).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SPOKESMEN).drop("nth")
        several = some.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"), F.max("i").alias("last")).where("x < y AND last > 0")
        # a row a family of several blocks
        blocks = F.broadcast(several.select("family", F.ceil(F.col("n") / block_docs).cast("int").alias("fewer")))
        level += 1
        met, seen = counted(some.join(blocks, "family").withColumn("i", _block(F.col("fewer"), level)).drop("fewer"), n=F.count(F.lit(1)))
        if seen["n"] == 0 or size is not None and 2 * seen["n"] > size:
            break
        size = seen["n"]
        found = components(_as_links(found).unionByName(_verified(met, threshold)), reduced=True)

    # what is not in its family's largest group is compared with all other groups
    label = _labelled(rows, found).select("doc_id", "family", "blocks", "i", "label", "shingles")
    groups = label.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    most = groups.groupBy("family").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    left, seen = counted(most.where("most.n < all").select("family", F.col("most.label").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / block_docs).cast("int").alias("strays")), n=F.count(F.lit(1)))
    if seen["n"] == 0:
        return _as_links(found)
    open_rows = label.join(F.broadcast(left), "family")
    home = open_rows.withColumns({"j": F.explode(F.sequence(F.lit(0), F.col("strays") - 1)), "side": F.lit(0)})
    stray = open_rows.where("label <> main").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"j": _block(F.col("strays"), -2), "side": F.lit(1)})
    return _as_links(found).unionByName(_verified(home.select(PLACED).unionByName(stray.select(PLACED)), threshold))


def similar_groups(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut into words `[^\\x20\\x09-\\x0D]+`; a
    document's set is its distinct shingles of n words, or its one shorter
    sequence. Two documents link where the similarity of their sets is the
    threshold or more, exactly; component_id is the smallest id that links
    reach. A null or empty text has an empty set and links with nothing; a row
    with a null id has its size and no component of its own. Rows with equal
    ids are one document with several sets. A very long text is a set like any
    other; an empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    facts = stored(_facts(texts, n, threshold))
    known = facts.where("doc_id IS NOT NULL AND n_shingles > 0")

    # equal sets: each to the smallest id that has it, which alone goes on
    of_set, seen = counted(known.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("set_key", "least"), n=F.count(F.lit(1)))
    of_set = F.broadcast(of_set) if seen["n"] <= MOST_IDS else of_set
    equal = known.select("doc_id", "set_key").join(of_set, "set_key").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    alone = known.join(of_set, "set_key", "left").where("least IS NULL OR doc_id = least")

    agreed = _near(_members(alone), threshold)
    families = components(agreed, reduced=True).select(F.col("id").alias("doc_id"), F.col("component").alias("family"))

    # families of one block are compared as they are, larger ones by blocks
    sized = alone.select("doc_id", "n_shingles").join(families, "doc_id")
    crowd = sized.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, F.sum("n_shingles") / (1000 * BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed, seen = counted(families.join(crowd, "family").select("doc_id", "family", "blocks"), small=F.count_if(F.col("blocks") == 1), large=F.count_if(F.col("blocks") > 1))
    named = texts.where("doc_id IS NOT NULL")
    small = _sets_of(named, placed.where("blocks = 1"), seen["small"], n).withColumns({"i": F.lit(0), "j": F.lit(-1), "side": F.lit(0), "label": F.col("doc_id")})
    links = equal.unionByName(_verified(small, threshold))
    if seen["large"]:
        large = placed.where("blocks > 1")
        links = links.unionByName(_links_of_large(stored(_sets_of(named, large, seen["large"], n)), threshold, block_docs))
    found = components(links, reduced=True)
    facts = facts.select("doc_id", "n_shingles")
    return facts.join(found, facts["doc_id"] == found["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns; rows with a null id stay."""
    return without_keys(docs, F.col("doc_id"), similar_groups(docs, n, threshold).where("component_id <> doc_id").select("doc_id"))
