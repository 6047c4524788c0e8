"""Causal conformal calibration as a stream that takes rows in event time, with timers.

Rows wait in state until the watermark has passed them, so those that come out of
order within its delay are taken in time order, as the batch form takes them. Rows
that come later than that are dropped by the watermark and change nothing. What is
kept of a site is the rows that wait, and its last ``window`` scores twice: in the
order they came, to evict, and sorted, to read a rank without sorting again.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

OUTPUT = "site int, raw_row long, ts timestamp, score double, expansion double"


class SlidingScores:
    """The last ``window`` scores in the order they came and in sorted order; an insert or an eviction moves no more than the list's tail."""

    def __init__(self, window: int, scores: list[float]):
        self.window, self.scores, self.ordered = window, list(scores), sorted(scores)

    def expansion(self, alpha: float) -> float | None:
        rank = math.ceil((len(self.ordered) + 1) * (1 - alpha))
        return self.ordered[rank - 1] if self.ordered and rank <= len(self.ordered) else None

    def add(self, score: float) -> None:
        self.scores.append(score)
        bisect.insort(self.ordered, score)
        if len(self.scores) > self.window:
            gone = self.scores.pop(0)
            del self.ordered[bisect.bisect_left(self.ordered, gone)]


class Calibrator(StatefulProcessor):
    def __init__(self, window: int, alpha: float):
        self.window, self.alpha = window, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, raw_row long, score double")
        self.history = handle.getValueState("history", "scores array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                at = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
                self.waiting.appendList(list(zip(at, frame["raw_row"].tolist(), frame["score"].astype(float).tolist(), strict=True)))
                for t in sorted({t // 1000 + 1 for t in at}):
                    self.handle.registerTimer(t)
        yield pd.DataFrame({c: pd.Series(dtype=d) for c, d in (("site", "int32"), ("raw_row", "int64"), ("ts", "datetime64[us]"), ("score", "float64"), ("expansion", "float64"))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] // 1000 < due]
        if not ready:
            return
        held = self.history.get()
        scores = SlidingScores(self.window, list(held[0]) if held is not None else [])
        found = []
        for _, _, score in ready:
            found.append(scores.expansion(self.alpha))
            scores.add(score)
        self.history.update((scores.scores,))
        left = rows[len(ready) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield pd.DataFrame(
            {
                "site": pd.Series([int(key[0])] * len(ready), dtype="int32"),
                "raw_row": [r[1] for r in ready],
                "ts": pd.to_datetime([r[0] for r in ready], unit="us"),
                "score": [r[2] for r in ready],
                "expansion": pd.Series([math.nan if e is None else e for e in found], dtype="float64"),
            }
        )

    def close(self) -> None:
        pass


def stream_ordered_expansions(scores: DataFrame, window: int = 256, alpha: float = 0.05, delay: str = "1 hour") -> DataFrame:
    """The expansion of each row of a stream of (site, raw_row, ts, score), told once the watermark, ``delay`` behind the latest row, has passed it.

    Rows that tie in time are taken by ``raw_row``; a row never sees its own
    score. An expansion is NULL while the history is too short. The state store has
    to be RocksDB's, which timers and list state need.
    """
    known = scores.select("site", "raw_row", "ts", "score").where("ts IS NOT NULL AND score IS NOT NULL").withWatermark("ts", delay)
    return known.groupBy("site").transformWithStateInPandas(Calibrator(window, alpha), StructType.fromDDL(OUTPUT), "Append", "EventTime")
