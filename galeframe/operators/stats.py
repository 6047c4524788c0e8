"""Aggregates, exact quantiles, densities, distribution distances, ranks and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.operators.quantiles import exact_percentiles, joined
from galeframe.operators.ranges import RANGE, in_ranges, joined_cells, own_rows, running, with_neighbours


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, least, most and the sample deviation (NULL for one row)."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.stddev_samp(value).alias("sd_value")
    )


def loglog_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R2 of log10(y) on log10(x); keys of fewer than two rows are left out."""
    lx, ly = F.log10(x), F.log10(y)
    fitted = df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys)
    return fitted.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"), F.count(F.lit(1)).alias("n")).where("n >= 2")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return exact_percentiles(df, keys, {name: (value, p) for name, p in shares.items()})


def rank_statistic(df: DataFrame, keys: list[str], score: str, alpha: float, finite_sample: bool = True) -> DataFrame:
    """A conformal quantile, found by its rank so that no group is gathered in one array.

    finite_sample: the ceil((n + 1)(1 - alpha))-th smallest, NULL where there is
    none; otherwise the one at ceil((n - 1)(1 - alpha)) from 0 ("higher").
    """
    ties = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__rows"))
    rows = running(in_ranges(ties, keys, [score]), {"__up": F.col("__rows")}).frame
    rank = F.ceil((F.col("__up_all") + 1) * F.lit(1 - alpha)) if finite_sample else F.ceil((F.col("__up_all") - 1) * F.lit(1 - alpha)) + 1
    here = (F.col("__up") >= rank) & (F.col("__up") - F.col("__rows") < rank)
    return rows.groupBy(*keys).agg(F.max("__up_all").alias("n"), F.max(F.when(here, F.col(score))).alias("q_hat"))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, tau: float) -> DataFrame:
    """The first value at which the weight up to it reaches tau of all; rows without weight are left out."""
    rows = df.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    rows = running(in_ranges(rows, keys, [value]), {"__up": F.col("__w")}).frame
    return rows.where(F.col("__up") >= tau * F.col("__up_all")).groupBy(*keys).agg(F.min(value).alias("quantile"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts and density of equal bins; values outside are dropped, the last bin holds its upper end, empty bins are there."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    counted = inside.groupBy(*keys, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return full.withColumn("density", F.when(total > 0, F.col("n") / (total * width)).otherwise(0.0))


def smooth(df: DataFrame, keys: list[str], order: str, value: str, taps: int = 7, name: str = "smoothed") -> DataFrame:
    """A Gaussian kernel of ``taps`` taps and deviation taps / 3, padded with zeros."""
    half = taps // 2
    raw = [math.exp(-0.5 * (k / (taps / 3)) ** 2) for k in range(-half, half + 1)]
    ranged = with_neighbours(in_ranges(df, keys, [order]), half, half)
    w = ranged.window()
    out = F.lit(0.0)
    for k, tap in zip(range(-half, half + 1), raw, strict=True):
        here = F.col(value) if k == 0 else F.lag(value, -k, 0.0).over(w) if k < 0 else F.lead(value, k, 0.0).over(w)
        out = out + here * (tap / sum(raw))
    return own_rows(ranged, ranged.frame.withColumn(name, out))


def density_estimate(df: DataFrame, keys: list[str], value: str, grid: list[float]) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth at each point of a fixed grid.

    The grid is a list in the plan, so the sample is read once and summed by
    task before it is shuffled.
    """
    spread = df.where(F.col(value).isNotNull()).groupBy(*keys).agg((F.stddev_samp(value) * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"))
    points = F.explode(F.array([F.lit(float(g)) for g in grid])).alias("at")
    rows = df.where(F.col(value).isNotNull()).join(spread.where("h > 0"), keys).select(*keys, value, "h", points)
    kernel = F.exp(-0.5 * F.pow((F.col("at") - F.col(value)) / F.col("h"), 2)) / (F.col("h") * math.sqrt(2 * math.pi))
    return rows.groupBy(*keys, "at").agg(F.avg(kernel).alias("density"))


def distribution_distance(df: DataFrame, keys: list[str], value: str, is_target: str) -> DataFrame:
    """Wasserstein-1 and Kolmogorov-Smirnov distance of two samples, ties collapsed first."""
    steps = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(~F.col(is_target)).alias("a"), F.count_if(F.col(is_target)).alias("b"))
    ranged = with_neighbours(running(in_ranges(steps, keys, [value]), {"__a": F.col("a"), "__b": F.col("b")}), after=1)
    gap = F.abs(F.col("__a") / F.col("__a_all") - F.col("__b") / F.col("__b_all"))
    rows = own_rows(ranged, ranged.frame.withColumns({"__gap": gap, "__step": F.lead(value).over(ranged.window()) - F.col(value)}))
    return rows.groupBy(*keys).agg(F.sum(F.col("__gap") * F.coalesce("__step", F.lit(0.0))).alias("wasserstein"), F.max("__gap").alias("ks"))


def residual_moments(df: DataFrame, keys: list[str], residual: str, tail: float) -> DataFrame:
    e = F.col(residual)
    found = df.groupBy(*keys).agg(
        F.avg(e).alias("mean_e"), F.stddev_pop(e).alias("sd_e"), F.skewness(e).alias("skew_e"), F.kurtosis(e).alias("kurt_e"), F.avg((F.abs(e) > tail).cast("double")).alias("tail_share")
    )
    return joined(found, exact_percentiles(df.select(*keys, F.abs(e).alias("__abs")), keys, {"abs_p95": ("__abs", 0.95)}), keys)


def average_rank(df: DataFrame, keys: list[str], value: Column, name: str = "rank") -> DataFrame:
    """Rank of a value within its key; ties share the mean of their ranks."""
    rows = df.withColumn("__value", value)
    ties = rows.groupBy(*keys, "__value").agg(F.count(F.lit(1)).alias("__rows"))
    ties = running(in_ranges(ties, keys, ["__value"]), {"__up": F.col("__rows")}).frame
    ties = ties.select(*keys, "__value", (F.col("__up") - (F.col("__rows") - 1) / 2).alias(name))
    return joined_cells(rows, ties, [*keys, "__value"]).drop("__value")


def signal_power(df: DataFrame, vector: str) -> DataFrame:
    """Mean square of each element over the rows: pos, power."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double") * F.col("x").cast("double")).alias("power"))


def feature_correlation(df: DataFrame, vector: str, target: str) -> DataFrame:
    """Correlation of each element with the target; 0 where there is none."""
    rows = df.select(F.col(target).cast("double").alias("y"), F.posexplode(vector).alias("pos", "x"))
    r = F.corr(F.col("x").cast("double"), "y")
    return rows.groupBy("pos").agg(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("r"))


def select_features(correlations: DataFrame, least: float, k: int) -> DataFrame:
    """Features with |r| of at least ``least``; where there is none, the k with the largest |r|, the later of equals first."""
    rows = correlations.withColumns({"__any": F.max((F.abs("r") >= least).cast("int")).over(Window.partitionBy(F.lit(0))), "__rank": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("r")), F.desc("pos")))})
    return rows.where(((F.col("__any") == 1) & (F.abs("r") >= least)) | ((F.col("__any") == 0) & (F.col("__rank") <= k))).drop("__any", "__rank")


def mad_scale(df: DataFrame, keys: list[str], residual: str) -> DataFrame:
    found = exact_percentiles(df.select(*keys, F.abs(F.col(residual)).alias("__abs")), keys, {"scale": ("__abs", 0.5)})
    return found.withColumn("scale", 1.4826 * F.col("scale"))


def mean_impute(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A missing value becomes the mean of its key, or 0 where all are missing."""
    means = df.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("__mean"))
    return df.join(means, keys).withColumn(name, F.coalesce(value, "__mean")).drop("__mean")


def balanced_moments(df: DataFrame, keys: list[str], value: str, is_target: str) -> DataFrame:
    """Mean and population deviation with half of the weight on each domain; a zero deviation counts as 1, a single domain has all the weight."""
    x, t = F.col(value), F.col(is_target)
    sums = df.groupBy(*keys).agg(F.avg(F.when(~t, x)).alias("ms"), F.avg(F.when(t, x)).alias("mt"), F.avg(F.when(~t, x * x)).alias("qs"), F.avg(F.when(t, x * x)).alias("qt"))
    half = lambda a, b: (F.coalesce(F.col(a), F.col(b)) + F.coalesce(F.col(b), F.col(a))) / 2
    rows = sums.select(*keys, half("ms", "mt").alias("mean_value"), half("qs", "qt").alias("__q"))
    deviation = F.sqrt(F.greatest(F.col("__q") - F.col("mean_value") * F.col("mean_value"), F.lit(0.0)))
    return rows.select(*keys, "mean_value", F.when(deviation == 0, 1.0).otherwise(deviation).alias("scale"))


def site_mean(df: DataFrame, keys: list[str], site: str, value: str, capacity: DataFrame) -> DataFrame:
    """Mean over sites of value / capacity, in percent: every site counts once."""
    return df.join(F.broadcast(capacity), site).groupBy(*keys).agg((100 * F.avg(F.col(value) / F.col("capacity"))).alias("macro_percent"), F.count_distinct(site).alias("sites"))


def squared_errors(df: DataFrame, task: str = "task", method: str = "method", seed: str = "seed") -> DataFrame:
    """RMSE of each run, then its mean over seeds."""
    runs = df.groupBy(task, method, seed).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).alias("rmse"))
    return runs.groupBy(task, method).agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("runs"))


def holm(df: DataFrame, family: list[str], p: str, tie: list[str], name: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment within each family."""
    w = Window.partitionBy(*family)
    order = w.orderBy(p, *tie)
    rows = df.withColumns({"__rn": F.row_number().over(order), "__m": F.count(F.lit(1)).over(w)})
    step = F.max((F.col("__m") - F.col("__rn") + 1) * F.col(p)).over(Window.partitionBy(*family).orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.least(F.lit(1.0), step)).drop("__rn", "__m")
