"""Scores of point, interval and quantile forecasts, each one aggregate over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions.scalar import interval_score, pinball


def point_scores(y: Column, prediction: Column, epsilon: float = 1e-6) -> dict[str, Column]:
    """rmse, mae, mape in percent, and R2 (NULL where y is constant)."""
    e = prediction - y
    total = F.var_pop(y) * F.count(y)
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mape": 100 * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(epsilon))),
        "r2": F.when(total > 0, 1 - F.sum(e * e) / total),
    }


def coverage(y: Column, lower: Column, upper: Column) -> Column:
    return F.avg(y.between(lower, upper).cast("double"))


def interval_scores(y: Column, lower: Column, upper: Column, alpha: float, gamma: float = 0.3, eta: float = 2.0) -> dict[str, Column]:
    """picp, mpiw, pinaw (NULL where y has no span), cwc and the mean Winkler score."""
    picp = coverage(y, lower, upper)
    mpiw = F.avg(upper - lower)
    pinaw = mpiw / F.nullif(F.max(y) - F.min(y), F.lit(0.0))
    penalty = 1 + gamma * F.exp(-eta * (picp - (1 - alpha)))
    return {"picp": picp, "mpiw": mpiw, "pinaw": pinaw, "cwc": F.when(picp >= 1 - alpha, pinaw).otherwise(pinaw * penalty), "winkler": F.avg(interval_score(y, lower, upper, alpha))}


def strict_interval_scores(df: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """picp, mpiw and winkler; a row whose bounds are not in order is an error."""
    checked = F.when(F.col("lower") > F.col("upper"), F.raise_error(F.lit("lower bound above upper bound"))).otherwise(F.col("lower"))
    scores = interval_scores(F.col("y"), F.col("lower"), F.col("upper"), alpha)
    return df.withColumn("lower", checked.cast("double")).groupBy(*keys).agg(*(scores[n].alias(n) for n in ("picp", "mpiw", "winkler")))


def weighted_interval_score(y: Column, quantiles: Column, taus: list[float]) -> Column:
    """WIS of a row from its quantiles in rising order; the taus are symmetric and the middle one is the median."""
    k = len(taus) // 2
    out = 0.5 * F.abs(y - F.get(quantiles, F.lit(k)))
    for i in range(k):
        alpha = 2 * taus[i]
        out = out + alpha / 2 * interval_score(y, F.get(quantiles, F.lit(i)), F.get(quantiles, F.lit(len(taus) - 1 - i)), alpha)
    return out / (k + 0.5)


def mean_pinball(y: Column, quantiles: Column, taus: list[float]) -> Column:
    out = F.lit(0.0)
    for i, tau in enumerate(taus):
        out = out + pinball(y, F.get(quantiles, F.lit(i)), tau)
    return out / len(taus)


def reliability(df: DataFrame, keys: list[str], y: str, quantiles: str, taus: list[float]) -> DataFrame:
    """Share of rows at or below each quantile: tau, cdf and their distance, one row a tau."""
    rows = df.select(*keys, F.col(y).alias("__y"), F.posexplode(quantiles).alias("__k", "__q"))
    tau = F.element_at(F.array([F.lit(t) for t in taus]), F.col("__k") + 1)
    out = rows.groupBy(*keys, tau.alias("tau")).agg(F.avg((F.col("__y") <= F.col("__q")).cast("double")).alias("cdf"))
    return out.withColumn("distance", F.abs(F.col("cdf") - F.col("tau")))


def crossing(df: DataFrame, keys: list[str], quantiles: list[Column]) -> DataFrame:
    """Share of rows with a decrease, mean positive decrease over all neighbours, mean of the rows' largest over crossed rows."""
    drops = [F.greatest(a - b, F.lit(0.0)) for a, b in zip(quantiles, quantiles[1:], strict=False)]
    largest = F.greatest(*drops) if len(drops) > 1 else drops[0]
    total = drops[0]
    for d in drops[1:]:
        total = total + d
    return df.groupBy(*keys).agg(
        F.avg((largest > 0).cast("double")).alias("crossing_rate"),
        F.avg(total / len(drops)).alias("mean_decrease"),
        F.coalesce(F.avg(F.when(largest > 0, largest)), F.lit(0.0)).alias("mean_largest"),
    )


def arg_best(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row of each key that is least in ``order``, found by one partial aggregate."""
    best = F.min_by(F.struct(*columns), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")

