"""Gradient boosting over binned features, one Spark job a level of a tree.

Features are binned once, by quantiles from mergeable sketches, and kept as bytes.
A level is one pass: each task sums the slopes and rows of every (node, feature,
bin) and sends the table, whose size is the model's; the best split of each node
is chosen from the total. What the finished trees say of a row is kept with it and
brought up to date every ``FOLDED`` trees, so a pass never walks more than those.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.sources.storage import settled

BINS = 64
FOLDED = 10
#: Accuracy of the sketches of bins and of leaves' quantiles: one rank in so many.
ACCURACY = 10_000
BINNED = "bins binary, y double, fitted double"


@dataclass
class Tree:
    """Nodes in the order they were made: feature and last bin of the left side (-1: a leaf), the left child (the right one follows it), and the value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row."""
        feature, last, left = (np.array(a) for a in (self.feature, self.bin, self.left))
        at = np.zeros(len(bins), dtype=np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            at[inner] = left[here] + (bins[inner, feature[here]] > last[here])


@dataclass
class Boosted:
    edges: list[np.ndarray]
    start: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """A bin holds values up to its edge; NaN is above all of them."""
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def of_bins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += self.rate * np.array(tree.value)[tree.leaves(bins)]
        return out

    def predict(self, df: DataFrame, vector: str, name: str = "prediction") -> DataFrame:
        """``df`` with the prediction of each row that has a vector, in one pass; others have none."""
        model, at, names = self, len(df.columns), [*df.columns, name]

        def run(batches):
            for batch in batches:
                x = batch.column(at)
                known = x.is_valid().to_numpy(zero_copy_only=False)
                out = np.full(batch.num_rows, np.nan)
                if known.any():
                    values = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)
                    out[known] = model.start + model.of_bins(model.binned(values))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, mask=~known)], names=names)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.select("*", F.col(vector).cast("array<double>").alias("__x")).mapInArrow(run, f"{fields}, `{name}` double")


def bin_edges(df: DataFrame, vector: str, bins: int = BINS) -> list[np.ndarray]:
    """The upper edges of each element's bins but the last, at quantiles of its values."""
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    shares = "array(" + ", ".join(f"{k / bins!r}D" for k in range(1, bins)) + ")"
    value = lambda f: f"CASE WHEN isnan(`{vector}`[{f}]) THEN NULL ELSE `{vector}`[{f}] END"
    found = df.agg(*(F.expr(f"percentile_approx({value(f)}, {shares}, {ACCURACY})").alias(f"e{f}") for f in range(width))).first() if width else []
    return [np.unique(np.array(e if e is not None else [], dtype=float)) for e in found]


def slopes(y: np.ndarray, fitted: np.ndarray, tau: float | None) -> np.ndarray:
    """What a tree is grown on: residuals, or for a quantile their signs' slopes."""
    return y - fitted if tau is None else np.where(y >= fitted, tau, tau - 1.0)


def best_split(sums: np.ndarray, counts: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) from (feature, bin) tables; of gains that are equal in nine digits the first."""
    total, n = sums[0].sum(), counts[0].sum()
    left, nl = sums.cumsum(axis=1)[:, :-1], counts.cumsum(axis=1)[:, :-1]
    right, nr = total - left, n - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left**2 / nl + right**2 / nr - total**2 / n
    gain[(nl < least) | (nr < least)] = -np.inf
    scale = max(abs(total) ** 2 / max(n, 1), float(np.max(gain, initial=0)), 1e-300)
    gain = np.where(np.isfinite(gain), np.round(gain / scale, 9), -np.inf)
    at = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or gain.flat[at] <= 1e-9:
        return None
    return float(gain.flat[at] * scale), at // gain.shape[1], at % gain.shape[1]


def _level(rows: DataFrame, model: Boosted, first: int, tree: Tree, nodes: list[int], tau: float | None, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and rows of every (node, feature, bin) of the given nodes, in one pass."""
    width = len(model.edges)
    size = len(nodes) * width * bins
    place = {node: k for k, node in enumerate(nodes)}

    def run(batches):
        total = np.zeros(2 * size)
        for batch in batches:
            if not batch.num_rows:
                continue
            binned, y, fitted = _columns(batch, width)
            slope = slopes(y, fitted + model.of_bins(binned, first), tau)
            node = np.array([place.get(k, -1) for k in range(len(tree.feature))])[tree.leaves(binned)]
            some = node >= 0
            cell = (node[some, None] * width + np.arange(width)) * bins + binned[some]
            total[:size] += np.bincount(cell.ravel(), np.repeat(slope[some], width), minlength=size)
            total[size:] += np.bincount(cell.ravel(), minlength=size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["pos", "value"])

    total = np.zeros(2 * size)
    for pos, value in rows.mapInArrow(run, "pos long, value double").groupBy("pos").agg(F.sum("value")).collect():
        total[pos] = value
    return total[:size].reshape(len(nodes), width, bins), total[size:].reshape(len(nodes), width, bins)


def _columns(batch, width: int):
    binned = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
    return binned, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))


def _folded(rows: DataFrame, model: Boosted, first: int) -> DataFrame:
    width = len(model.edges)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                binned, _, fitted = _columns(batch, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fitted + model.of_bins(binned, first))], names=["bins", "y", "fitted"])

    return settled(rows.mapInArrow(run, BINNED))


def _leaf_quantiles(rows: DataFrame, model: Boosted, first: int, tree: Tree, tau: float) -> dict[int, float]:
    """The quantile of the residuals of each leaf, from a mergeable sketch."""
    width = len(model.edges)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                binned, y, fitted = _columns(batch, width)
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(binned)), pa.array(y - fitted - model.of_bins(binned, first))], names=["leaf", "residual"])

    found = rows.mapInArrow(run, "leaf long, residual double").groupBy("leaf").agg(F.percentile_approx("residual", F.lit(float(tau)), F.lit(ACCURACY)).alias("value"))
    return {r["leaf"]: r["value"] for r in found.collect()}


def boost(df: DataFrame, vector: str, target: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, tau: float | None = None, least: int = 20, bins: int = BINS) -> Boosted:
    """Boosted trees of the mean or, with ``tau``, of that quantile.

    Rows without a vector or target are left out; without rows every prediction
    is 0. A node with fewer than ``least`` rows on a side is not split. Ties go to
    the first feature and bin.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins are bytes: 2 to 256")
    known = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    begin = known.agg(F.avg("y") if tau is None else F.percentile_approx("y", F.lit(float(tau)), F.lit(ACCURACY))).first()[0]
    if begin is None:
        return Boosted([], 0.0, rate)
    model = Boosted(bin_edges(known, "x", bins), float(begin), rate)

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                binned = model.binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in binned], pa.binary()), batch.column(1), pa.array(np.full(len(binned), model.start))], names=["bins", "y", "fitted"])

    rows, first = settled(known.mapInArrow(cut, BINNED)), 0
    for _ in range(rounds):
        tree, nodes = Tree(), [0]
        for level in range(depth + (tau is None)):  # the values of the mean's leaves are one level more
            sums, counts = _level(rows, model, first, tree, nodes, tau, bins)
            following = []
            for k, node in enumerate(nodes):
                n = counts[k, 0].sum() if counts.shape[1] else 0
                if tau is None and n:
                    tree.value[node] = float(sums[k, 0].sum() / n)
                found = best_split(sums[k], counts[k], least) if level < depth and counts.shape[1] else None
                if found is not None:
                    tree.feature[node], tree.bin[node], tree.left[node] = found[1], found[2], len(tree.feature)
                    for _ in range(2):
                        following.append(len(tree.feature))
                        for column, value in ((tree.feature, -1), (tree.bin, 0), (tree.left, 0), (tree.value, 0.0)):
                            column.append(value)
            nodes = following
            if not nodes:
                break
        if tau is not None:
            for leaf, value in _leaf_quantiles(rows, model, first, tree, tau).items():
                tree.value[leaf] = float(value)
        model.trees.append(tree)
        if len(model.trees) - first >= FOLDED:
            rows, first = _folded(rows, model, first), len(model.trees)
    return model
