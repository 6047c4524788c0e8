"""Causal conformal calibration as a stream: each forecast is widened by the scores before it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "site int, raw_row long, score double, expansion double"


def rank_of(history: list[float], alpha: float) -> float | None:
    k = math.ceil((len(history) + 1) * (1 - alpha))
    return sorted(history)[k - 1] if history and k <= len(history) else None


def stream_expansions(scores: DataFrame, window: int = 256, alpha: float = 0.05) -> DataFrame:
    """Expansion of each row of a stream of (site, raw_row, ts, score); the state of a site is its last ``window`` scores.

    Rows of a micro-batch are taken in time order; a score is added after it was
    used, so a row never sees its own.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "raw_row"])
        found = []
        for score in rows["score"].tolist():
            found.append(rank_of(history, alpha))
            history = [*history, score][-window:]
        state.update((history,))
        yield pd.DataFrame({"site": int(key[0]), "raw_row": rows["raw_row"].to_numpy(), "score": rows["score"].to_numpy(), "expansion": pd.array(found, dtype="Float64").to_numpy(dtype=float, na_value=float("nan"))})

    return scores.groupBy("site").applyInPandasWithState(step, OUTPUT, "history array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, watermark: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """Rows and mean value by site and window of time, late rows dropped after the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "site").agg(F.count(F.lit(1)).alias("n"), F.avg("power").alias("mean_power"))
