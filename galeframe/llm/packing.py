"""Best-fit packing of documents into training sequences, with certified repacking.

Texts are tokenized where they are read; what moves afterwards is one small row
(document, piece, length) a piece. Pieces are spread over partitions, each of
which packs best-fit decreasing. A dual-feasible-function lower bound certifies
the number of bins of each partition: a partition that meets its bound is done.
Where bins are left over, the loosest bins are opened, their documents are
exchanged with those of other such partitions, and best-fit decreasing runs
again over the mixed pool; the last round pools what is left into fewer and
fewer partitions. A partition never holds more than ``PER_PARTITION`` pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, small_batches
from .subwords import default_path, word_encoder

CAPACITY = 4096
END_ID = 1
#: Most pieces that one task packs.
PER_PARTITION = 40_000
#: Exchanges between partitions that are above their bound.
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its whole text and ``END_ID``; a null or empty text
    is ``END_ID`` alone. Only documents of more than ``capacity`` ids are cut.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = word_encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1)), strict=True):
                ids = found + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that can hold ``lengths``, by dual feasible functions.

    For a cut k, lengths above capacity - k count as whole bins, lengths of at
    least k count as they are and shorter ones as nothing: the summed values,
    divided by the capacity, bound every packing from below. k = 0 is the plain
    sum. The best bound over all k is returned.
    """
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    above = np.cumsum(count[::-1])[::-1]  # items at least this long
    mass = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])
    k = np.arange(0, capacity // 2 + 1)
    whole = np.concatenate([above, [0]])[capacity - k + 1]
    middle = mass[k] - mass[capacity - k + 1]
    return int((whole + -(-middle // capacity)).max())


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins; longest first, each into the fullest bin that takes it."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r left
    used = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            target = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, target = capacity, used
            used += 1
        bins[item], offsets[item] = target, capacity - room
        left = room - length
        if left:
            with_room[left].append(target)
            rooms |= 1 << left
    return bins, offsets, used


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fixed boolean"


def _pack_round(pool: DataFrame, partitions: int, round_no: int, last: bool, capacity: int) -> DataFrame:
    """Packs each partition; ``fixed`` rows have their sequence, the others go to the next round."""

    def run(batches):
        tables = list(batches)
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        if rows.num_rows == 0:
            return
        # partition contents in a fixed order, whatever order the shuffle delivered
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]))
        lengths = rows["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fixed = np.ones(len(lengths), dtype=bool)
        if not last and used > lower_bound(lengths, capacity):
            # bins above the bound come from gaps: open the loosest bins, which hold nearly all of them
            gap = capacity - np.bincount(bins, weights=lengths, minlength=used)
            order = np.argsort(-gap, kind="stable")
            loose = order[: max(2, int(np.searchsorted(np.cumsum(gap[order]), gap.sum() * 0.9)) + 1)]
            fixed = ~np.isin(bins, loose[gap[loose] > 0])
        number = (np.int64(round_no) << 58) | (np.int64(TaskContext.get().partitionId()) << 28) | bins
        for name, column in (("bin", number), ("offset", offsets), ("fixed", fixed)):
            rows = rows.append_column(name, pa.array(column))
        yield from rows.to_batches(max_chunksize=20_000)

    spread = pool.repartition(partitions, F.xxhash64("doc_id", "piece", F.lit(round_no))) if partitions > 1 else pool.coalesce(1)
    return spread.mapInArrow(run, PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Ties in length are broken by document and piece, so a run repeats itself.
    A piece as long as the capacity has a sequence of its own. Repeated rows
    are packed as often as they occur. An empty table gives no rows.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = settled(pieces.select(columns))
    full = F.col("length") == capacity
    done = [pieces.where(full).select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool = pieces.where(~full)
    for round_no in range(1, rounds + 1):
        n = pool.count()
        partitions = -(-n // per_partition)
        last = round_no == rounds or partitions <= 1
        packed = settled(_pack_round(pool, max(1, partitions), round_no, last, capacity))
        done.append(packed.where("fixed").select(*columns, F.col("bin").alias("sequence_id"), "offset"))
        if last:
            break
        pool = packed.where("NOT fixed").select(columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
