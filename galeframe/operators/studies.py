"""Studies as tables: ablation variants, tuning by score, and searches selected on validation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.functions.scalar import pinball
from galeframe.operators import learning, metrics


def variants(variance: float, discrepancy: float) -> list[tuple[str, float, float]]:
    """The full model and the models without one or both of its terms; nothing else differs."""
    return [("Full", variance, discrepancy), ("NoVariance", 0.0, discrepancy), ("NoDiscrepancy", variance, 0.0), ("Weighted", 0.0, 0.0)]


def tune_width(validation: DataFrame, scales: list[float], tau: float) -> DataFrame:
    """Per task the half-width whose two quantiles have the smallest mean pinball loss, the smaller of equals."""
    rows = validation.select("*", F.explode(F.array([F.lit(s) for s in scales])).alias("scale"))
    loss = (pinball(F.col("y"), F.col("prediction") - F.col("scale"), tau) + pinball(F.col("y"), F.col("prediction") + F.col("scale"), 1 - tau)) / 2
    scores = rows.groupBy("task", "scale").agg(F.round(F.avg(loss), 9).alias("score"))
    return metrics.arg_best(scores, ["task"], [F.col("score"), F.col("scale")], ["scale"])


def ridge_search(spark: SparkSession, df: DataFrame, penalties: list[float], seed: int = 0) -> DataFrame:
    """Ridge for each penalty: moments of the training rows once, a validation score each, the least (rmse, penalty) selected."""
    part = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(4))
    found = learning.moments(df.where(part != 0).withColumn("is_target", F.lit(False)), "x", "y", "is_target")
    held = df.where(part == 0)
    out = None
    for penalty in penalties:
        w, b = learning.ridge(found, penalty)
        scored = learning.predict_linear(held, "x", w, b).agg(*(c.alias(n) for n, c in metrics.point_scores(F.col("y"), F.col("prediction")).items())).select(F.lit(penalty).alias("penalty"), "rmse", "mae", "r2")
        out = scored if out is None else out.unionByName(scored)
    best = out.agg(F.min(F.struct("rmse", "penalty")).alias("b")).first()["b"]
    return out.withColumn("selected", F.col("penalty") == best["penalty"])


# --- designs, selections and locks as tables


def hashed(*parts) -> Column:
    """A hash of the parts as text, to order rows by; any engine with MD5 gives the same order."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def latin_hypercube(spark: SparkSession, n: int, ranges: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """``n`` points (point, then a column a range): each range is cut into n strata and each stratum has one point, at its middle."""
    out = spark.range(n).select(F.col("id").alias("point"))
    whole = Window.partitionBy(F.lit(0))  # a design is a few rows
    for name, (low, high) in ranges.items():
        stratum = F.row_number().over(whole.orderBy(hashed(F.lit(seed), F.lit(name), F.col("point"))))
        out = out.withColumn(name, F.lit(low) + (F.lit(high) - F.lit(low)) * (stratum - 0.5) / n)
    return out


def refined(selected: DataFrame, tried: DataFrame, steps: dict[str, list[float]], ranges: dict[str, tuple[float, float]], digits: int = 6) -> DataFrame:
    """Points around the selected ones, cut to the ranges, each effective signature once and none that was tried."""
    out = selected.select(*steps)
    for name, offsets in steps.items():
        low, high = ranges[name]
        moved = out.select(*steps, F.explode(F.array(*(F.lit(o) for o in offsets))).alias("__step"))
        out = moved.withColumn(name, F.greatest(F.lit(low), F.least(F.lit(high), F.col(name) + F.col("__step")))).drop("__step")
    rounded = [F.round(c, digits).alias(c) for c in steps]
    return out.select(*rounded).distinct().join(tried.select(*rounded), list(steps), "left_anti")


def select_certified(results: DataFrame, keys: list[str], candidate: str, seed: str, score: str, certified: str) -> DataFrame:
    """Per key the candidate with the least mean score over its seeds; one uncertified or missing seed excludes a candidate."""
    seeds = results.groupBy(*keys).agg(F.count_distinct(seed).alias("wanted"))
    per = results.groupBy(*keys, candidate).agg(F.round(F.avg(score), 9).alias("score"), F.min(F.col(certified).cast("int")).alias("fine"), F.count_distinct(seed).alias("seeds"))
    fine = per.join(seeds, keys).where("fine = 1 AND seeds = wanted")
    return metrics.arg_best(fine, keys, [F.col("score"), F.col(candidate)], [candidate, "score"])


def lock(selections: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """``selections`` with the SHA-256 of each row and whether all expected keys are there, each once."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in selections.columns))
    size = selections.agg(F.count(F.lit(1)).alias("__n"), F.count_distinct(*keys).alias("__d"))
    rows = selections.withColumn("record_sha256", F.sha2(text, 256)).crossJoin(F.broadcast(size))
    return rows.withColumn("complete", (F.col("__n") == expected) & (F.col("__d") == expected)).drop("__n", "__d")


def verified(locked: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's status: ok, changed, missing or added since the lock."""
    both = locked.select(*keys, F.col("record_sha256").alias("then")).join(now.select(*keys, F.col("record_sha256").alias("now")), keys, "full")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "added").when(F.col("then") == F.col("now"), "ok").otherwise("changed")
    return both.select(*keys, status.alias("status"))


def aliased(jobs: DataFrame, signature: list[str], order: str) -> DataFrame:
    """Jobs of one effective signature are fitted once: ``same_as`` names the first of them."""
    return jobs.withColumn("same_as", F.first(order).over(Window.partitionBy(*signature).orderBy(order)))
