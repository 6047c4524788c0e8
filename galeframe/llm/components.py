"""Connected components of a links table, in DataFrame operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, settled

#: Links that one task connects at most; more go through rounds of stars.
MOST_LINKS = 1_000_000
#: Ids whose components are broadcast to a join, at most.
MOST_FOUND = 200_000
#: Links that a task holds before it reduces them.
MOST_HELD = 1 << 20


def reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, for each the smallest id that the links ``a[i]`` - ``b[i]`` reach)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return ids, ids[root]


def forest(batches, roots: bool = False):
    """Batches (id, component) of what the links of one task reach, each id once a task; with ``roots`` also of the smallest ids themselves."""
    held, n = [], 0

    def reduced(whole):
        ids, least = reached(*(np.concatenate(c) for c in zip(*held, strict=True)))
        told = np.ones(len(ids), dtype=bool) if whole else ids != least
        return ids[told], least[told]

    def batch_out(pair):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pair], names=["id", "component"])

    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)))
        n += batch.num_rows
        if n > MOST_HELD:
            held = [reduced(False)]
            n = len(held[0][0])
            if n > MOST_HELD // 2 and not roots:  # these links stay as they are, and the task begins anew
                yield batch_out(held[0])
                held, n = [], 0
    if held:
        yield batch_out(reduced(roots))


def _forest(links: DataFrame, roots: bool = False) -> DataFrame:
    """(id, component): what the links of each task reach."""
    return links.mapInArrow(lambda batches: forest(batches, roots), "id long, component long")


def _least_neighbour(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every id has at most one smaller neighbour, and then no larger one."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", reduced: bool = False) -> DataFrame:
    """(id, component) for every id in ``links``: the smallest id reachable from it.

    Every task reduces its own links to one from each id to the smallest that
    they reach. ``reduced`` links come from such tasks already (:func:`forest`):
    they are not handed to Python again, where a second worker for each task
    would stay beside the first and hold memory of its own. What is left of them, up to ``MOST_LINKS``, is connected by one
    task. More go through large and small stars in turn: every id hands its
    larger neighbours, then its smaller ones, to the smallest id it knows. Each
    round is two joins on partially aggregated minima; edges of an id with many
    links meet in one partition, which adaptive execution splits. The rounds end
    when every id has one link to an id that has none, and their number grows
    with the logarithm of the longest chain. Loops and repeated links change
    nothing; links with a null end are left out.
    """
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    whole = whole.select(F.col(a).cast("long").alias("id"), F.col(b).cast("long").alias("component"))
    edges, seen = counted(whole if reduced else _forest(whole), n=F.count(F.lit(1)))
    if seen["n"] <= MOST_LINKS:
        found, seen = counted(_forest(edges.coalesce(1), roots=True), n=F.count(F.lit(1)))
        return F.broadcast(found) if seen["n"] <= MOST_FOUND else found
    edges = edges.toDF("u", "v")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = _least_neighbour(large)
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = settled(small.where("u <> v").distinct())
    least = edges.groupBy("u").agg(F.min("v").alias("component"))
    return settled(least.select(F.col("u").alias("id"), "component").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
