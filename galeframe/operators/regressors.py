"""Regressors that Spark ML does not have: mini-batch Adam, boosted quantiles, random features, bounded-loss ridge, exact nearest neighbours and density intervals.

Each pass over the rows sends sums of the model's size; models are at most a few
hundred numbers and meet the rows as expressions or blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from galeframe.functions import scalar as fx
from galeframe.operators import learning as ln
from galeframe.operators.quantiles import exact_percentiles

#: Rows of a query block that meets all rows of the other side at once.
QUERY_BLOCK = 4096


def adam_fit(df: DataFrame, vector: str, target: str, cost: str, taus: list[float], terms: tuple[np.ndarray, np.ndarray], batches: int, epochs: int, rate: float = 0.01, key: str = "row_id", seed: int = 0) -> np.ndarray:
    """Weights and intercept (last) of each tau after ``epochs`` of Adam over mini-batches.

    Minimised is w'Rw / 2 - c'w + the sum of cost * pinball(y - Zw - b). Rows
    are dealt to batches by a hash of their key and the seed, so a step's
    gradient is a sum over one batch, taken in Spark for all taus together; the
    regulariser is scaled by the batch's share of the rows. Batches that got no
    row take no step.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("z"), F.col(target).cast("double").alias("y"), F.col(cost).cast("double").alias("cost"), F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(batches)).cast("int").alias("batch"))
    # sorted by batch, so that a step reads the cached blocks of its own batch only
    rows = rows.where("z IS NOT NULL AND y IS NOT NULL AND cost > 0").sortWithinPartitions("batch").persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {x["batch"]: x["count"] for x in rows.groupBy("batch").count().collect()}  # a row a batch
        n, d = sum(sizes.values()), len(terms[1]) + 1
        quadratic, linear = np.zeros((d, d)), np.zeros(d)
        quadratic[:-1, :-1], linear[:-1] = terms
        at, first, second, step = np.zeros((len(taus), d)), np.zeros((len(taus), d)), np.zeros((len(taus), d)), 0
        tau = np.array(taus)
        for _ in range(epochs):
            for batch, size in sorted(sizes.items()):

                def slopes(x, y, cost, at=at):
                    e = y[:, None] - x @ at.T
                    return (-(np.where(e >= 0, tau, tau - 1) * cost[:, None]).T @ x).ravel()

                found = ln._total(rows.where(F.col("batch") == batch).select("z", "y", "cost"), slopes, len(taus) * d).reshape(-1, d)
                slope = found + size / n * (at @ quadratic - linear)
                step += 1
                first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
                at = at - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    finally:
        rows.unpersist()
    return at


def random_nodes(df: DataFrame, vector: str, groups: int, nodes: int, enhanced: int = 0, seed: int = 0, name: str = "h") -> DataFrame:
    """``df`` with tanh of seeded random projections of a vector; ``enhanced`` nodes more are projections of those."""
    width = df.select(F.size(vector)).first()[0]
    r = np.random.default_rng(seed)
    first, shift = r.standard_normal((width, groups * nodes)), r.standard_normal(groups * nodes)
    second, second_shift = r.standard_normal((groups * nodes, enhanced)), r.standard_normal(enhanced)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            h = np.tanh(x @ first + shift)
            h = np.hstack([h, np.tanh(h @ second + second_shift)])
            kept = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, h.shape[1], dtype=np.int32)), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, kept], schema=pa.schema([*batch.schema, pa.field(name, pa.list_(pa.float64()))]))

    return df.mapInArrow(run, schema)


def bounded_ridge(df: DataFrame, vector: str, target: str, penalty: float, least_scale: float = 0.1, rounds: int = 5, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Ridge by reweighting: a row weighs 1 / (1 + (residual / scale)^2), the scale being the median absolute deviation, ``least_scale`` at least.

    The intercept is not penalised. A round is one pass for the weighted moments and the passes of an exact median.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("z"), F.col(target).cast("double").alias("y"), F.lit(1.0).alias("cost")).where("z IS NOT NULL AND y IS NOT NULL").persist(StorageLevel.DISK_ONLY)
    try:
        d = rows.select(F.size("z")).first()[0] + 1
        regular = penalty * np.eye(d)
        regular[-1, -1] = 0.0
        at, scale = np.zeros(d), None
        for _ in range(rounds):

            def sums(x, y, cost, at=at, scale=scale):
                w = cost if scale is None else np.maximum(1 / (1 + ((y - x @ at) / scale) ** 2), 1e-6)
                return np.concatenate([((x * w[:, None]).T @ x).ravel(), (x * w[:, None]).T @ y])

            found = ln._total(rows, sums, d * d + d)
            before, at = at, np.linalg.solve(found[: d * d].reshape(d, d) + regular, found[d * d :])
            residuals = ln.predict_linear(rows, "z", at[:-1], float(at[-1])).select(F.abs(F.col("y") - F.col("prediction")).alias("e"))
            scale = max(least_scale, 1.4826 * exact_percentiles(residuals, [], {"m": ("e", 0.5)}).first()["m"] + 1e-6)
            change = np.linalg.norm(at[:-1] - before[:-1]) / (np.linalg.norm(before[:-1]) + 1e-8) + abs(at[-1] - before[-1]) / (abs(before[-1]) + 1e-8)
            if change < tolerance:
                break
    finally:
        rows.unpersist()
    return at[:-1], float(at[-1])


class BoostedQuantile:
    """Trees grown on the slope of the pinball loss; a leaf's value is the quantile of its residuals."""

    def __init__(self, tau: float, rate: float, start: float):
        self.tau, self.rate, self.start = tau, rate, start
        self.trees: list[tuple[object, dict[int, float]]] = []

    def predict(self, df: DataFrame, vector: str, name: str = "prediction") -> DataFrame:
        """All trees in one pass, without a join: leaf values are a literal map of at most 2^depth entries."""
        out, total, used = df.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>"))), F.lit(self.start), []
        for k, (tree, values) in enumerate(self.trees):
            used += [f"__p{k}", f"__l{k}"]
            out = tree.setFeaturesCol("__f").setPredictionCol(f"__p{k}").setLeafCol(f"__l{k}").transform(out)
            total = total + self.rate * F.element_at(F.create_map(*(F.lit(v) for leaf, value in sorted(values.items()) for v in (float(leaf), value))), F.col(f"__l{k}"))
        return out.withColumn(name, total).drop("__f", *used)


def boosted_quantile(df: DataFrame, vector: str, target: str, tau: float, rounds: int = 5, depth: int = 3, rate: float = 0.5, seed: int = 0) -> BoostedQuantile:
    """Gradient boosting of one quantile: each round grows a tree on the signs of the residuals and takes exact quantiles of its leaves."""
    rows = df.select(F.col(vector).alias("x"), F.col(target).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").persist(StorageLevel.DISK_ONLY)
    try:
        model = BoostedQuantile(tau, rate, float(exact_percentiles(rows, [], {"q": ("y", tau)}).first()["q"]))
        for k in range(rounds):
            now = model.predict(rows, "x", "now").withColumns({"e": F.col("y") - F.col("now"), "features": array_to_vector(F.col("x").cast("array<double>"))})
            tree = DecisionTreeRegressor(maxDepth=depth, seed=seed + k, labelCol="slope").fit(now.withColumn("slope", F.when(F.col("e") >= 0, tau).otherwise(tau - 1.0)))
            placed = tree.setFeaturesCol("features").setPredictionCol("__p").setLeafCol("leaf").transform(now)
            model.trees.append((tree, {int(x["leaf"]): float(x["value"]) for x in exact_percentiles(placed, ["leaf"], {"value": ("e", tau)}).collect()}))
    finally:
        rows.unpersist()
    return model


def nearest_mean(queries: DataFrame, rows: DataFrame, key: str, vector: str, target: str, k: int) -> DataFrame:
    """(key, prediction): the mean target of each query's k nearest rows, by distance and then by key.

    A stated query set against all rows: queries go in blocks of ``QUERY_BLOCK``,
    each task keeps its k best a query, and only those are shuffled. All rows
    are searched.
    """
    width = rows.select(F.size(vector)).first()[0]
    known = rows.where(F.col(vector).isNotNull() & F.col(target).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"), F.col(target).cast("double"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"))
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    out = None
    for block in range(blocks):
        # a hash deals half a block on average; the size is checked all the same
        part = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).toArrow() if blocks > 1 else asked.toArrow()
        if len(part) > QUERY_BLOCK:
            raise ValueError("keys of queries repeat too often to be dealt into blocks")
        q = part["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        names = part["key"].to_numpy()

        def run(batches, q=q, names=names):
            best, ids, ys = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max), np.zeros((len(q), k))
            for batch in batches:
                v, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(-1, width)
                for a in range(0, len(x), 1024):
                    far = np.stack([((x[a : a + 1024] - p) ** 2).sum(axis=1) for p in q]) if len(q) else np.zeros((0, len(x[a : a + 1024])))
                    m = far.shape[1]
                    every = np.hstack([best, far]), np.hstack([ids, np.broadcast_to(v[a : a + 1024], (len(q), m))]), np.hstack([ys, np.broadcast_to(y[a : a + 1024], (len(q), m))])
                    order = np.lexsort((every[1], every[0]), axis=1)[:, :k]
                    best, ids, ys = (np.take_along_axis(c, order, axis=1) for c in every)
            held = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)[held.ravel()]), pa.array(best[held]), pa.array(ids[held]), pa.array(ys[held])], names=["key", "far", "id", "y"])

        found = known.mapInArrow(run, "key long, far double, id long, y double")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("key").orderBy("far", "id"))
    return out.withColumn("place", place).where(F.col("place") <= k).groupBy("key").agg(F.avg("y").alias("prediction")).withColumnRenamed("key", key)


def density_intervals(df: DataFrame, key: list[str], prediction: str, residual: str, bins: int = 5, least: int = 20, bandwidth: float = 0.5, draws: int = 20, low: float = 0.05, high: float = 0.95, seed: int = 0) -> DataFrame:
    """Bounds from a Gaussian kernel density of the residuals of equal-count bins of the prediction.

    Every residual is drawn ``draws`` times with kernel noise that depends on its
    key and the seed, so the draws grow with the rows; their exact quantiles are
    the bounds. Bins of fewer than ``least`` rows use the draws of all rows.
    """
    drawn = df.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    noisy = fx.add_noise(F.col(residual), F.lit(bandwidth), F.concat_ws("|", *(F.col(c).cast("string") for c in key), F.col("__draw").cast("string")), seed)
    everywhere = exact_percentiles(drawn.select(noisy.alias("__e")), [], {"all_low": ("__e", low), "all_high": ("__e", high)})  # one row
    placed, sizes = ln._binned(df, prediction, residual, bins, {})
    again = placed.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("bin", noisy.alias("__e"))
    per = exact_percentiles(again, ["bin"], {"bin_low": ("__e", low), "bin_high": ("__e", high)}).join(sizes, "bin").crossJoin(F.broadcast(everywhere))
    rows = placed.join(F.broadcast(per), "bin")
    pick = lambda side: F.when(F.col("bin_n") < least, F.col(f"all_{side}")).otherwise(F.col(f"bin_{side}"))
    return rows.select(*df.columns, "bin", (F.col(prediction) + pick("low")).alias("lower"), (F.col(prediction) + pick("high")).alias("upper"))


def fitted(name: str, df: DataFrame, vector: str, target: str, **params):
    """The model factory: fits the model of that name and returns a function from rows to rows with ``prediction``."""

    def ridge(penalty=1.0):
        w, b = ln.ridge(ln.moments(df.withColumn("__t", F.lit(False)), vector, target, "__t"), penalty)
        return lambda rows: ln.predict_linear(rows, vector, w, b)

    def elm(hidden=32, penalty=1.0, seed=0):
        grown = random_nodes(df.select(vector, target), vector, 1, hidden, seed=seed).withColumn("__t", F.lit(False))
        w, b = ln.ridge(ln.moments(grown, "h", target, "__t"), penalty)
        return lambda rows: ln.predict_linear(random_nodes(rows, vector, 1, hidden, seed=seed), "h", w, b).drop("h")

    def bounded(penalty=1.0, rounds=5):
        w, b = bounded_ridge(df, vector, target, penalty, rounds=rounds)
        return lambda rows: ln.predict_linear(rows, vector, w, b)

    def forest(trees=8, depth=4, seed=0):
        model = ln.forest(df, vector, target, trees, depth, seed)
        return lambda rows: ln.predict_ml(rows, model, vector)

    def broad_forest(groups=2, nodes=8, enhanced=8, trees=8, depth=4, seed=0):
        model = ln.forest(random_nodes(df.select(vector, target), vector, groups, nodes, enhanced, seed), "h", target, trees, depth, seed)
        return lambda rows: ln.predict_ml(random_nodes(rows, vector, groups, nodes, enhanced, seed), model, "h").drop("h")

    def boosted(rounds=4, depth=3, seed=0):
        model = ln.boosted(df, vector, target, rounds, depth, seed)
        return lambda rows: ln.predict_ml(rows, model, vector)

    def quantile_boosted(tau=0.5, rounds=4, depth=3):
        model = boosted_quantile(df, vector, target, tau, rounds, depth)
        return lambda rows: model.predict(rows, vector)

    def pinball(tau=0.5, penalty=1.0, steps=200):
        jobs = df.sparkSession.createDataFrame([("fit", tau, 0)], "job string, tau double, seed int")
        fit = ln.fit_jobs(df, jobs, vector, target, penalty=penalty, most=steps).first()
        predict = lambda rows: ln.predict_linear(rows, vector, np.array(fit["weights"]), fit["intercept"])
        predict.certified = fit["converged"]
        return predict

    makers = {f.__name__: f for f in (pinball, ridge, elm, bounded, forest, broad_forest, boosted, quantile_boosted)}
    if name not in makers:
        raise ValueError(f"no model {name}; there are {', '.join(makers)}")
    return makers[name](**params)


def factory_scores(spark: SparkSession, df: DataFrame, held: DataFrame, vector: str, target: str, models: list[tuple[str, dict]]) -> DataFrame:
    """(model, rmse): each model of the list fitted on ``df`` and scored on ``held``."""
    out = None
    for name, params in models:
        scored = fitted(name, df, vector, target, **params)(held).agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2))).alias("rmse")).select(F.lit(name).alias("model"), "rmse")
        out = scored if out is None else out.unionByName(scored)
    return out
