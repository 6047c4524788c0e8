"""Paired block inference: bootstrap intervals, sign-flip and block-swap tests, comparisons and tiers.

Rows are reduced to one sum a block in Spark before any resampling; what a
Python function sees is the few blocks of one comparison.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions.scalar import stable_seed
from galeframe.operators.stats import holm

DRAWS = 5_000


def block_sums(df: DataFrame, keys: list[str], block: Column, value: Column) -> DataFrame:
    return df.groupBy(*keys, block.alias("block")).agg(F.sum(value).alias("block_sum"), F.count(value).alias("block_n"))


def paired_differences(df: DataFrame, reference: str, others: list[str] | None = None) -> DataFrame:
    """Per task, window and method other than the reference: difference of seed-mean squared errors, reference minus other.

    The two methods must hold the same windows; windows of one alone are left out.
    """
    loss = df.groupBy("task", "site", "method", "window_index").agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("loss"), F.min("ts").alias("ts"))
    base = loss.where(F.col("method") == reference).select("task", "window_index", F.col("loss").alias("base"))
    rest = loss.where((F.col("method") != reference) if others is None else F.col("method").isin(others))
    return rest.join(base, ["task", "window_index"]).select("task", "site", "method", "window_index", "ts", (F.col("base") - F.col("loss")).alias("difference"))


def resampled_ratio(sums: np.ndarray, counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    out = []
    for at in range(0, draws, DRAWS):
        pick = random.integers(0, len(sums), size=(min(DRAWS, draws - at), len(sums)))
        out.append(sums[pick].sum(axis=1) / counts[pick].sum(axis=1))
    return np.concatenate(out)


def sign_flip_p(sums: np.ndarray, counts: np.ndarray, draws: int, seed: int, two_sided: bool = True, tolerance: float = 1e-14) -> float:
    """(1 + number of flipped ratios at least as large) / (1 + draws)."""
    observed = sums.sum() / counts.sum()
    slack = tolerance * max(1.0, abs(observed))
    random = np.random.default_rng(seed)
    reached = 0
    for at in range(0, draws, DRAWS):
        flipped = random.choice(np.array([-1.0, 1.0]), size=(min(DRAWS, draws - at), len(sums))) @ sums / counts.sum()
        reached += int(np.sum(np.abs(flipped) >= abs(observed) - slack) if two_sided else np.sum(flipped >= observed - slack))
    return (1 + reached) / (draws + 1)


def block_inference(sums: DataFrame, keys: list[str], draws: int = 2000, seed: int = 0, alpha: float = 0.05, root: bool = False) -> DataFrame:
    """Per key: observed mean, its bootstrap interval over whole blocks, and the two- and one-sided sign-flip p.

    ``root``: the interval is of the signed square root of the mean.
    """
    kinds = ", ".join(f"{k} {dict(sums.dtypes)[k]}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        s, n = group["block_sum"].to_numpy(float), group["block_n"].to_numpy(float)
        own = stable_seed(seed, *(group[k].iloc[0] for k in keys))
        values = resampled_ratio(s, n, draws, own)
        shape = (lambda v: np.sign(v) * np.sqrt(np.abs(v))) if root else (lambda v: v)
        low, high = np.quantile(shape(values), [alpha / 2, 1 - alpha / 2])
        row = {k: group[k].iloc[0] for k in keys}
        row |= {"blocks": len(group), "observed": shape(s.sum() / n.sum()), "ci_low": low, "ci_high": high}
        row |= {"p_two_sided": sign_flip_p(s, n, draws, own), "p_one_sided": sign_flip_p(s, n, draws, own, two_sided=False)}
        return pd.DataFrame([row])

    return sums.groupBy(*keys).applyInPandas(run, f"{kinds}, blocks long, observed double, ci_low double, ci_high double, p_two_sided double, p_one_sided double")


def block_swap(df: DataFrame, a: str, b: str, block: Column, capacity: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Swap test of the site-equal normalised RMSE of two methods: one row.

    What is gathered is a row per site, seed and block, for one pair of methods.
    """
    error = F.pow(F.col("prediction") - F.col("y"), 2)
    pick = lambda m: F.sum(F.when(F.col("method") == m, error))
    count = lambda m: F.count_if(F.col("method") == m)
    blocks = df.where(F.col("method").isin(a, b)).groupBy("site", "seed", block.alias("block")).agg(pick(a).alias("sa"), pick(b).alias("sb"), count(a).alias("na"), count(b).alias("nb"))
    blocks = blocks.where("na > 0 AND nb > 0").join(F.broadcast(capacity), "site")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["site", "seed", "block"])
        levels = {x: k for k, x in enumerate(sorted(set(zip(rows["site"], rows["block"], strict=True))))}
        rows = rows.assign(level=[levels[x] for x in zip(rows["site"], rows["block"], strict=True)])
        random = np.random.default_rng(seed)

        def endpoint(signs: np.ndarray) -> np.ndarray:
            total = np.zeros(len(signs))
            sites = rows["site"].unique()
            for site in sites:
                part = rows[rows["site"] == site]
                difference = np.zeros(len(signs))
                for _, run_ in part.groupby("seed"):
                    middle = (run_["sa"].sum() + run_["sb"].sum()) / 2
                    half = signs[:, run_["level"].to_numpy()] @ ((run_["sa"] - run_["sb"]).to_numpy() / 2)
                    n = (run_["na"].sum() + run_["nb"].sum()) / 2
                    difference += np.sqrt(np.maximum(middle + half, 0) / n) - np.sqrt(np.maximum(middle - half, 0) / n)
                total += difference / part["seed"].nunique() / part["capacity"].iloc[0]
            return total / len(sites)

        observed = endpoint(np.ones((1, len(levels))))[0]
        reached = 0
        for at in range(0, draws, DRAWS):
            flipped = endpoint(random.choice(np.array([-1.0, 1.0]), size=(min(DRAWS, draws - at), len(levels))))
            reached += int(np.sum(np.abs(flipped) >= abs(observed) - 1e-14 * max(1.0, abs(observed))))
        return pd.DataFrame([{"method_a": a, "method_b": b, "observed": observed, "p_value": (1 + reached) / (draws + 1)}])

    return blocks.groupBy(F.lit(1).alias("__all")).applyInPandas(run, "method_a string, method_b string, observed double, p_value double")


def reference_comparisons(df: DataFrame, reference: str, block: Column, draws: int = 2000, seed: int = 0) -> DataFrame:
    """The reference minus every other method in every task, with Holm's adjustment over all rows."""
    tested = block_inference(block_sums(paired_differences(df, reference), ["task", "method"], block, F.col("difference")), ["task", "method"], draws, seed)
    return holm(tested.withColumn("family", F.lit(reference)), ["family"], "p_two_sided", ["task", "method"])


def first_tier(scores: DataFrame, tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per task: a method leaves the first tier if it is worse than the winner and its adjusted p is below alpha; the winner's p is 1."""
    best = scores.groupBy("task").agg(F.min_by("method", F.struct("rmse", "method")).alias("winner"), F.min("rmse").alias("best_rmse"))
    rows = scores.join(best, "task").join(tested.select("task", "method", "p_holm"), ["task", "method"], "left")
    p = F.when(F.col("method") == F.col("winner"), 1.0).otherwise(F.col("p_holm"))
    return rows.select("task", "method", "rmse", "winner", p.alias("p_holm"), (~((F.col("rmse") > F.col("best_rmse")) & F.coalesce(p < alpha, F.lit(False)))).alias("in_first_tier"))


def subsample_counts(n_source: int, n_target: int, total: int, target_ratio: float) -> tuple[int, int]:
    """Rows to take from each domain: the ratio as far as there are target rows, filled up from source, then target."""
    target = min(n_target, round(total * target_ratio))
    source = min(n_source, total - target)
    target = min(n_target, target + max(0, total - target - source))
    return source, target
