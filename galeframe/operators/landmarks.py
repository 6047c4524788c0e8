"""Weighted k-means centres, all starts in the same passes over the rows.

Each start draws candidates round by round, rows far from what it has being
likelier (k-means++ by oversampling: a round takes as many rows as there are
centres, so a few passes do), weighs them by the rows they stand for, and
thins them to k by k-means++ among the candidates. Then all starts iterate
together. Tasks send sums of the centres' size, or the rows they drew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS = 4
ITERATIONS = 20
TOLERANCE = 1e-4
#: Distances that a task holds at once.
MOST_DISTANCES = 1 << 21


def _uniform(mark: np.ndarray, *seeds: int) -> np.ndarray:
    """A number in (0, 1] of each row and seed, the same wherever the row is."""
    x = mark.view(np.uint64).copy()
    for s in seeds:
        x += np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 1) / (1 << 53)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0)


def _parts(batches, most: int):
    """(x, weight, mark) of the rows, so many at once that their distances to ``most`` centres fit."""
    step = max(1, MOST_DISTANCES // max(1, most))
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            w, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for at in range(0, len(x), step):
                yield x[at : at + step], w[at : at + step], mark[at : at + step]


def _drawn(rows: DataFrame, candidates: list[np.ndarray], take: int, seed: int, number: int) -> list[np.ndarray]:
    """For each start ``take`` rows more, drawn without replacement by weight times squared distance to its candidates (without any: by weight)."""

    def run(batches):
        held: list[list] = [[] for _ in candidates]
        for x, w, mark in _parts(batches, max(len(c) for c in candidates) or 1):
            for s, own in enumerate(candidates):
                pull = w * (squared(x, own).min(axis=1) if len(own) else 1.0)
                some = np.flatnonzero(pull > 1e-300)
                key = -np.log(_uniform(mark[some], seed, number, s)) / pull[some]
                best = some[np.argsort(key, kind="stable")[:take]]
                held[s] += zip(np.sort(key)[:take].tolist(), x[best].tolist(), strict=True)
                held[s] = sorted(held[s])[:take]
        starts = [s for s, own in enumerate(held) for _ in own]
        flat = [r for own in held for r in own]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([k for k, _ in flat], pa.float64()), pa.array([x for _, x in flat], pa.list_(pa.float64()))], names=["start", "key", "x"])

    found = rows.mapInArrow(run, "start int, key double, x array<double>")
    place = F.row_number().over(Window.partitionBy("start").orderBy("key", "x"))
    found = found.withColumn("place", place).where(F.col("place") <= take).collect()  # starts x take rows
    out = []
    for s, own in enumerate(candidates):
        new = [r["x"] for r in sorted((r for r in found if r["start"] == s), key=lambda r: r["place"])]
        both = [*own.tolist(), *new]
        out.append(np.unique(np.array(both), axis=0) if both else own)
    return out


def _sums(rows: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each start, in one pass: the weighted sum and the weight of each centre's rows, and the cost."""
    every = np.vstack(centres)
    width, ends = every.shape[1], np.cumsum([0, *(len(c) for c in centres)])
    size = len(every) * (width + 1) + len(centres)

    def run(batches):
        total = np.zeros(size)
        sums, mass, cost = total[: len(every) * width].reshape(-1, width), total[len(every) * width : len(every) * (width + 1)], total[len(every) * (width + 1) :]
        for x, w, _ in _parts(batches, len(every)):
            far = squared(x, every)
            for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                near = far[:, a:b].argmin(axis=1)
                cost[s] += w @ far[np.arange(len(x)), a + near]
                np.add.at(sums, a + near, x * w[:, None])
                np.add.at(mass, a + near, w)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pos", "value"])

    total = np.zeros(size)
    for pos, value in rows.mapInArrow(run, "pos long, value double").groupBy("pos").agg(F.sum("value")).collect():
        total[pos] = value
    sums, mass, cost = np.split(total, [len(every) * width, len(every) * (width + 1)])
    sums = sums.reshape(-1, width)
    return [(sums[a:b], mass[a:b], float(cost[s])) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def _thinned(candidates: np.ndarray, mass: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates by k-means++, and a few rounds of k-means among them."""
    if len(candidates) <= k:
        return candidates
    chosen = [int(random.choice(len(candidates), p=mass / mass.sum()))]
    near = squared(candidates, candidates[chosen]).min(axis=1)
    while len(chosen) < k:
        pull = mass * near
        if pull.sum() <= 0:
            break
        chosen.append(int(random.choice(len(candidates), p=pull / pull.sum())))
        near = np.minimum(near, squared(candidates, candidates[chosen[-1:]])[:, 0])
    centres = candidates[chosen]
    for _ in range(10):
        own = squared(candidates, centres).argmin(axis=1)
        for c in range(len(centres)):
            if mass[own == c].sum() > 0:
                centres[c] = np.average(candidates[own == c], axis=0, weights=mass[own == c])
    return centres


def weighted_landmarks(df: DataFrame, vector: str, k: int, seed: int = 0, weight: str | None = None, starts: int = 10) -> tuple[np.ndarray, float]:
    """The centres of the cheapest of ``starts`` and their cost, the weighted sum of squared distances.

    Rows without a vector or of no weight are left out. There are fewer than k
    centres if there are fewer different rows. A row's draws depend on its vector
    and the seed, so repeated rows are drawn together.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("x IS NOT NULL AND w > 0")
    rows = rows.withColumn("mark", F.xxhash64("x")).persist(StorageLevel.DISK_ONLY)
    try:
        candidates = [np.zeros((0, 0))] * starts
        for number in range(ROUNDS):
            candidates = _drawn(rows, candidates, 1 if number == 0 else k, seed, number)
        if not len(candidates[0]):
            raise ValueError("no rows to place landmarks in")
        random = np.random.default_rng(seed)
        centres = [_thinned(c, m, k, random) for c, (_, m, _) in zip(candidates, _sums(rows, candidates), strict=True)]
        before = [np.inf] * starts
        for step in range(ITERATIONS + 1):
            found = _sums(rows, centres)
            costs = [cost for _, _, cost in found]
            settled = all(b - c <= TOLERANCE * max(c, 1e-300) for b, c in zip(before, costs, strict=True))
            if settled or step == ITERATIONS:
                break
            before = costs
            centres = [np.where(m[:, None] > 0, s / np.maximum(m, 1e-300)[:, None], c) for c, (s, m, _) in zip(centres, found, strict=True)]
    finally:
        rows.unpersist()
    best = int(np.argmin(costs))
    return centres[best], costs[best]
