"""Fitting and prediction: moments, landmarks, Nystroem features, certified pinball fits, trees and residual intervals.

Sufficient statistics are summed in Spark. What a driver or one task solves is
the size of a model (at most 512 features), never of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from galeframe.operators.landmarks import weighted_landmarks
from galeframe.operators.quantiles import exact_percentiles

MOST_FEATURES = 512
#: Newton steps that are tried at once, from undamped to one that cannot overshoot.
TRIALS = 14
#: Numbers of a point up to which slopes are told ahead of need.
MOST_AHEAD = 128
#: Rows that a task measures at once; what it holds beside its batch does not grow with the batch.
ROWS_AT_ONCE = 1024


@dataclass
class Moments:
    """Count, sums and second moments of features, target and domains."""

    n: np.ndarray  # source, target
    sums: np.ndarray  # domain x feature
    gram: np.ndarray  # domain x feature x feature
    cross: np.ndarray  # domain x feature
    y: np.ndarray  # domain sums of the target

    @property
    def mean(self) -> np.ndarray:
        return self.sums / np.maximum(self.n, 1)[:, None]

    def covariance(self, domain: int = 0) -> np.ndarray:
        m = self.mean[domain]
        return self.gram[domain] / self.n[domain] - np.outer(m, m)

    def cross_covariance(self, domain: int = 0) -> np.ndarray:
        return self.cross[domain] / self.n[domain] - self.mean[domain] * self.y[domain] / self.n[domain]

    def discrepancy(self) -> np.ndarray:
        return self.mean[0] - self.mean[1]


def moments(df: DataFrame, vector: str, target: str, is_target: str) -> Moments:
    """Both domains' moments in one pass: each task sends one table of the model's size, summed by position."""
    width = df.select(F.size(vector)).first()[0]
    if width > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")

    def run(batches):
        n, sums, gram, cross, ys = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width)), np.zeros((2, width)), np.zeros(2)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            y, t = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for d, rows in enumerate((~t, t)):
                n[d] += rows.sum()
                sums[d] += x[rows].sum(axis=0)
                gram[d] += x[rows].T @ x[rows]
                cross[d] += x[rows].T @ y[rows]
                ys[d] += y[rows].sum()
        flat = np.concatenate([n, sums.ravel(), gram.ravel(), cross.ravel(), ys])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["pos", "value"])

    parts = df.select(vector, F.col(target).cast("double"), is_target).mapInArrow(run, "pos long, value double")
    flat = np.array([r[1] for r in sorted(parts.groupBy("pos").agg(F.sum("value")).collect())])
    cut = np.cumsum([2, 2 * width, 2 * width * width, 2 * width])
    n, sums, gram, cross, y = np.split(flat, cut)
    return Moments(n, sums.reshape(2, width), gram.reshape(2, width, width), cross.reshape(2, width), y)


def ridge(found: Moments, penalty: float) -> tuple[np.ndarray, float]:
    """Ridge weights and intercept over both domains, from their moments alone."""
    n = found.n.sum()
    mean, my = found.sums.sum(axis=0) / n, found.y.sum() / n
    gram = found.gram.sum(axis=0) - n * np.outer(mean, mean)
    cross = found.cross.sum(axis=0) - n * mean * my
    w = np.linalg.solve(gram + penalty * np.eye(len(mean)), cross)
    return w, float(my - mean @ w)


def landmarks(df: DataFrame, vector: str, k: int, seed: int = 0, weight: str | None = None, runs: int = 10) -> np.ndarray:
    """Centres of weighted k-means, the cheapest of several starts that share their passes."""
    return weighted_landmarks(df, vector, k, seed, weight, runs)[0]


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def nystroem_map(centres: np.ndarray, gamma: float, jitter: float = 1e-6) -> np.ndarray:
    """The inverse root of the landmarks' kernel; a kernel that is not positive raises."""
    values, vectors = np.linalg.eigh(rbf(centres, centres, gamma) + jitter * np.eye(len(centres)))
    if values.min() <= 0:
        raise np.linalg.LinAlgError("landmark kernel is not positive definite")
    return vectors / np.sqrt(values) @ vectors.T


def nystroem_features(df: DataFrame, vector: str, centres: np.ndarray, gamma: float, name: str = "z") -> DataFrame:
    """``df`` with the Nystroem features of a vector; blocks of rows meet the landmarks in one product."""
    root = nystroem_map(centres, gamma)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, centres.shape[1])
            z = rbf(x, centres, gamma) @ root
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * root.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, kept], schema=pa.schema([*batch.schema, pa.field(name, pa.list_(pa.float64()))]))

    return df.mapInArrow(run, schema)


def domain_terms(found: Moments, variance: float, discrepancy: float) -> tuple[np.ndarray, np.ndarray]:
    """(R, c) of w'Rw / 2 - c'w: the norm of w, the centred residual variance of the source, and the difference of the domains' means.

    Up to a constant, |w|^2 / 2 + variance / 2 * var_S(y - Zw) + discrepancy / 2 * (w'(mean_S - mean_T))^2.
    """
    apart = found.discrepancy() if found.n.min() > 0 else np.zeros(found.sums.shape[1])
    cov, cross = (found.covariance(), found.cross_covariance()) if found.n[0] > 0 else (np.zeros_like(found.gram[0]), np.zeros(len(apart)))
    return np.eye(len(apart)) + variance * cov + discrepancy * np.outer(apart, apart), variance * cross


def _total(rows: DataFrame, measure, size: int) -> np.ndarray:
    """The sum over all rows of ``measure(x, y, cost)``: each task sends one table of the model's size; x ends with a one for the intercept."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, cost = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for at in range(0, len(z), ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                total += measure(np.hstack([z[part], np.ones((len(z[part]), 1))]), y[part], cost[part])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["pos", "value"])

    found = rows.mapInArrow(run, "pos long, value double").groupBy("pos").agg(F.sum("value")).collect()
    return np.array([r[1] for r in sorted(found)])


def fit_jobs(
    df: DataFrame, jobs: DataFrame, vector: str, target: str, penalty: float = 1.0, most: int = 200, relative: float = 1e-4, absolute: float = 1e-7,
    cost: str | None = None, terms: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, resume: DataFrame | None = None,
) -> DataFrame:
    """A pinball fit for every row of ``jobs`` (job, tau, seed), each on all rows whose vector and target are known.

    Minimised is w'Rw / 2 - c'w + the sum over rows of cost * pinball(y - Zw - b).
    ``cost`` is a column (one over the number of rows if not given); ``terms``
    holds R and c of a job, which else are ``penalty`` times one and zero. The
    pinball is smoothed within ``delta`` of its kink and minimised by damped
    Newton steps, ``delta`` falling until the gap of the unsmoothed primal and
    dual closes. Tasks send sums of the model's size only, and the driver solves
    systems of that size. All rows train, so fits do not depend on the seed.

    A fit's row is also the state of its solver. Jobs that stand in ``resume``, a
    table of such rows, go on from there: ``most`` caps the steps of all runs
    together, and best primal, dual and steps are carried on. A job whose
    certificate is closed is told as it was.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("z"), F.col(target).cast("double").alias("y"), (F.col(cost).cast("double") if cost else F.lit(1.0)).alias("cost")).where("z IS NOT NULL AND y IS NOT NULL AND cost > 0").persist(StorageLevel.DISK_ONLY)
    try:
        found = _fit_all(rows, jobs.select("job", "tau", "seed").collect(), penalty, most, relative, absolute, cost is None, terms or {}, _states(resume))  # one row a fit
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(found, FIT)


#: A certified fit, and where its solver stands: the smoothing and the point of the last step.
FIT = "job string, tau double, seed int, n long, primal double, dual double, iterations long, converged boolean, intercept double, weights array<double>, delta double, point array<double>"


def _states(resume: DataFrame | None) -> dict:
    """The state of each job, of several the one with most steps."""
    if resume is None:
        return {}
    last = Window.partitionBy("job").orderBy(F.desc("iterations"), "primal")
    return {r["job"]: r for r in resume.withColumn("__k", F.row_number().over(last)).where("__k = 1").collect()}


def _fit_all(rows: DataFrame, jobs: list, penalty: float, most: int, relative: float, absolute: float, mean: bool, terms: dict, states: dict) -> list[tuple]:
    n, least, width, spread, mass = rows.agg(F.count(F.lit(1)), F.min(F.size("z")), F.max(F.size("z")), F.stddev_pop("y"), F.sum("cost")).first()
    if not n or not jobs:
        return []
    if least != width or width > MOST_FEATURES:
        raise ValueError(f"vectors of different lengths or of more than {MOST_FEATURES} features")
    d, tau = width + 1, np.array([float(j["tau"]) for j in jobs])
    share_of_row = 1 / n if mean else 1.0
    mass *= share_of_row
    own = [terms.get(j["job"], (penalty * np.eye(width), np.zeros(width))) for j in jobs]
    base, linear = np.zeros((len(jobs), d, d)), np.zeros((len(jobs), d))
    for k, (r, c) in enumerate(own):
        base[k, :width, :width], linear[k, :width] = r, c
    starts = rows.agg(F.percentile_approx("y", F.array(*(F.lit(t) for t in tau.tolist())))).first()[0]
    at = [np.append(np.zeros(width), b) for b in starts]
    delta = np.full(len(jobs), max(float(spread), 1e-6))
    best, dual, done = [(np.inf, p) for p in at], np.full(len(jobs), -np.inf), np.zeros(len(jobs), dtype=np.int64)
    sums = _total(rows, lambda x, y, cost: np.append(cost @ x, [cost @ y, cost @ (x * x).sum(axis=1)]), d + 2) * share_of_row
    for k, j in enumerate(jobs):
        state = states.get(j["job"])
        if state is not None:
            if len(state["point"]) != d or state["tau"] != tau[k]:
                raise ValueError(f"the state of {j['job']} is of another fit")
            at[k], delta[k], dual[k], done[k] = np.array(state["point"]), state["delta"], state["dual"], state["iterations"]
            best[k] = (state["primal"], np.append(state["weights"], state["intercept"]))
    live = [k for k in range(len(jobs)) if done[k] < most and not _closed(best[k][0], dual[k], relative, absolute)]
    slope_size = d + 1 + d * d
    ahead = len(jobs) > 0 and d <= MOST_AHEAD
    known: dict[int, np.ndarray] = {}  # slopes that the pass over the trials told already
    while live:
        wanted = [k for k in live if k not in known]
        if wanted:
            measure = _slopes([(at[k], delta[k], tau[k]) for k in wanted])
            known |= dict(zip(wanted, np.split(_total(rows, measure, len(wanted) * slope_size) * share_of_row, len(wanted)), strict=True))
        trials = {}
        for k in live:
            found = known.pop(k)
            ax, ay, curve = found[:d], found[d], found[d + 1 :].reshape(d, d) + base[k]
            over = ax[-1]  # the free intercept wants multipliers that sum to zero
            limit = tau[k] - 1 if over > 0 else tau[k]
            share = abs(over) / max(abs(over - limit * mass), 1e-300)
            # each multiplier moves by its share of the room to its limit
            bx, by = ax - share * (ax - limit * sums[:d]), ay - share * (ay - limit * sums[d])
            pull = bx[:width] + linear[k, :width]
            dual[k] = max(dual[k], by - 0.5 * pull @ np.linalg.solve(base[k, :width, :width], pull))
            slope = base[k] @ at[k] - linear[k] - ax
            steepest = np.linalg.norm(base[k], 2) + sums[d + 1] / delta[k]  # no curvature is above this
            trials[k] = np.array([at[k], *(at[k] - np.linalg.solve(curve + m * np.eye(d), slope) for m in np.geomspace(1e-9, steepest, TRIALS))])

        # the smooth and the true objective at each trial and, as it is mostly the one that is taken, the slopes at the undamped step
        m = TRIALS + 1
        values = _values([(trials[k], delta[k], tau[k]) for k in live])
        guesses = [(k, w) for k in live for w in (delta[k], delta[k] / 4)] if ahead else []
        slopes = _slopes([(trials[k][1], w, tau[k]) for k, w in guesses])
        told = _total(rows, lambda x, y, cost, f=values, g=slopes: np.concatenate([f(x, y, cost), g(x, y, cost)]), len(live) * 2 * m + len(guesses) * slope_size) * share_of_row
        guessed = dict(zip(guesses, told[len(live) * 2 * m :].reshape(len(guesses), slope_size), strict=True))
        for k, found in zip(live, np.split(told[: len(live) * 2 * m], len(live)), strict=True):
            norm = 0.5 * np.einsum("ij,jk,ik->i", trials[k], base[k], trials[k]) - trials[k] @ linear[k]
            smooth, true = found[:m] + norm, found[m:] + norm
            if true.min() < best[k][0]:
                best[k] = (float(true.min()), trials[k][true.argmin()])
            taken = int(smooth.argmin())
            at[k] = trials[k][taken]
            if smooth[0] - smooth.min() <= 0.01 * delta[k] * mass:  # smoothing costs at most half of delta
                delta[k] = max(delta[k] / 4, 0.25 * (absolute + relative * max(1.0, abs(best[k][0]))) / mass)
            if taken == 1 and (k, delta[k]) in guessed:
                known[k] = guessed[k, delta[k]]
            done[k] += 1
        live = [k for k in live if done[k] < most and not _closed(best[k][0], dual[k], relative, absolute)]
    return [
        (j["job"], float(j["tau"]), j["seed"], n, best[k][0], float(dual[k]), int(done[k]), _closed(best[k][0], dual[k], relative, absolute), float(best[k][1][-1]), best[k][1][:width].tolist(), float(delta[k]), at[k].tolist())
        for k, j in enumerate(jobs)
    ]


def _slopes(points: list):
    """Of each (point, width of the kink, tau): the multipliers' sums with x and y, and the curvature."""

    def measure(x, y, cost):
        out = [np.zeros(0)]
        for p, width_of_kink, t in points:
            e = (y - x @ p) / width_of_kink
            a = np.clip(e, t - 1, t) * cost
            inside = (e > t - 1) & (e < t)
            bent = x[inside]
            out.append(np.concatenate([a @ x, [a @ y], ((bent * cost[inside, None]).T @ bent).ravel() / width_of_kink]))
        return np.concatenate(out)

    return measure


def _values(tried: list):
    """Of each (points, width of the kink, tau): the smoothed and the true loss at every point."""

    def measure(x, y, cost):
        out = []
        for p, width_of_kink, t in tried:
            e = y[:, None] - x @ p.T
            a = np.clip(e / width_of_kink, t - 1, t)
            out += [cost @ (a * e - width_of_kink * a * a / 2), cost @ np.maximum(t * e, (t - 1) * e)]
        return np.concatenate(out)

    return measure


def _closed(primal: float, dual: float, relative: float, absolute: float) -> bool:
    return bool(np.isfinite(primal) and np.isfinite(dual) and primal - dual <= absolute + relative * max(1.0, abs(primal), abs(dual)))


def predict_linear(df: DataFrame, vector: str, weights: np.ndarray, intercept: float, name: str = "prediction") -> DataFrame:
    """Z w + b as a Spark expression."""
    w = F.array(*(F.lit(float(v)) for v in weights))
    dot = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(name, dot + float(intercept))


def forest(df: DataFrame, vector: str, target: str, trees: int = 20, depth: int = 5, seed: int = 0):
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(target).cast("double").alias("label"))
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def boosted(df: DataFrame, vector: str, target: str, rounds: int = 10, depth: int = 3, seed: int = 0):
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(target).cast("double").alias("label"))
    return GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed).fit(rows)


def predict_ml(df: DataFrame, model, vector: str, name: str = "prediction") -> DataFrame:
    rows = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.setPredictionCol(name).transform(rows).drop("features")


def forest_interval(df: DataFrame, model, vector: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Quantiles of the predictions of a forest's trees, row by row."""
    out = df.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>")))
    names = []
    for k, tree in enumerate(model.trees):
        names.append(f"__t{k}")
        out = tree.setFeaturesCol("__f").setPredictionCol(names[-1]).transform(out)
    ordered = F.array_sort(F.array(*names))

    def at(share: float):
        place = share * (len(names) - 1)
        floor = int(place)
        a, b = F.get(ordered, F.lit(floor)), F.get(ordered, F.lit(min(floor + 1, len(names) - 1)))
        return a + (b - a) * (place - floor)

    return out.withColumns({"lower": at(low), "upper": at(high)}).drop("__f", *names)


def cluster_boosted(df: DataFrame, vector: str, target: str, k: int = 3, least: int = 30, seed: int = 0) -> DataFrame:
    """Boosted trees for each k-means cluster, the global model for clusters of fewer than ``least`` rows."""
    rows = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows)
    placed = model.transform(rows).drop("features")
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}
    whole = boosted(df, vector, target, seed=seed)
    out = None
    for cluster, size in sorted(sizes.items()):
        part = placed.where(F.col("cluster") == cluster)
        scored = predict_ml(part, whole if size < least else boosted(part, vector, target, seed=seed), vector)
        out = scored if out is None else out.unionByName(scored)
    return out


def _binned(df: DataFrame, prediction: str, residual: str, bins: int, shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """``df`` with its equal-count bin of the prediction and ``all_<name>``, and (bin, bin_n, bin_<name>): exact percentiles of the residuals of all rows and of a bin."""
    wanted = {f"edge_{k}": (prediction, k / bins) for k in range(1, bins)} | {f"all_{n}": (residual, p) for n, p in shares.items()}
    edges = exact_percentiles(df, [], wanted)  # one row
    placed = df.crossJoin(F.broadcast(edges)).withColumn("bin", sum(((F.col(f"edge_{k}") < F.col(prediction)).cast("int") for k in range(1, bins)), F.lit(0)))
    placed = placed.drop(*(f"edge_{k}" for k in range(1, bins)))
    per = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("bin_n"))
    if shares:
        per = per.join(exact_percentiles(placed, ["bin"], {f"bin_{n}": (residual, p) for n, p in shares.items()}), "bin")
    return placed, per


def residual_intervals(df: DataFrame, prediction: str, residual: str, bins: int = 5, least: int = 20, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Bounds from the residuals of equal-count bins of the prediction; bins of fewer than ``least`` rows use all residuals.

    The bin edges are one row, and the residual quantiles one row a bin.
    """
    placed, per = _binned(df, prediction, residual, bins, {"low": low, "high": high})
    rows = placed.join(F.broadcast(per), "bin")
    return rows.select(*df.columns, "bin", (F.col(prediction) + F.when(F.col("bin_n") < least, F.col("all_low")).otherwise(F.col("bin_low"))).alias("lower"), (F.col(prediction) + F.when(F.col("bin_n") < least, F.col("all_high")).otherwise(F.col("bin_high"))).alias("upper"))


