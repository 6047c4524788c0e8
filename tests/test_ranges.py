"""Windows over ranges of a key equal windows over the whole key, and one key is many tasks."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.operators import ranges, stats, timeseries
from galeframe.plans import catalog

from .conftest import SMALL
from .test_catalogue import comparable, sql  # noqa: F401

#: Queries over whole keys; ``ROWS_PER_RANGE`` is so small that every key has many ranges.
OVER_RANGES = [
    "W1_lag_windows", "W2_lag_sequences", "W3_fit_statistics", "W7_ramp", "W11_widest_segment", "W12_neighbourhood", "W13_rolling_expansion", "W14_evenly_spaced", "W17_positional_split",
    "W18_shuffled_split", "W19_label_budgets", "G6_conformal_rank", "G7_conformal_higher", "G8_weighted_quantile", "G10_smoothing", "G12_wasserstein", "G13_kolmogorov_smirnov", "G20_average_ranks", "G21_wins",
    "T20_zero_width_intervals", "T30_conformalised_intervals",
]


@pytest.mark.parametrize("name", OVER_RANGES)
def test_query_over_many_ranges_equals_its_sql(spark, sql, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 60)
    found, expected = catalog.QUERIES[name](spark, SMALL).toPandas(), sql.execute(catalog.ORACLES[name]).df()
    pd.testing.assert_frame_equal(comparable(found), comparable(expected), check_dtype=False, rtol=0, atol=1e-6)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with nearly all rows, sparse keys, a NULL key, NULL and tied times."""
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None]), None if r.random() < 0.01 else r.randint(0, 900), k, r.choice([None, *range(20)])) for k in range(3000)]
    return spark.createDataFrame(rows, "site string, at int, row int, x int").repartition(5).cache()


def plain(skewed, **columns):
    w = Window.partitionBy("site").orderBy("at", "row")
    return sorted(tuple(map(str, x)) for x in skewed.select("row", *(c(w).alias(n) for n, c in columns.items())).collect())


@pytest.mark.parametrize("rows_per_range", [7, 100, 1 << 20])
def test_running_sums_positions_and_neighbours(skewed, rows_per_range, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", rows_per_range)
    keys, order = ["site"], ["at", "row"]
    dealt = ranges.in_ranges(skewed, keys, order)
    assert dealt.many == (rows_per_range < 3000)
    found = ranges.positions(ranges.running(dealt, {"s": F.col("x")})).frame
    expected = plain(skewed, s=lambda w: F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), at=lambda w: F.row_number().over(w), n=lambda w: F.count(F.lit(1)).over(Window.partitionBy("site")))
    assert sorted(tuple(map(str, x)) for x in found.select("row", F.coalesce("s", F.lit(0)), "__at", "__n").collect()) == expected
    for before, after in ((1, 0), (0, 2), (40, 5)):
        near = ranges.with_neighbours(dealt, before, after)
        got = ranges.own_rows(near, near.frame.withColumn("near", F.collect_list("row").over(near.window().rowsBetween(-before, after))))
        expected = plain(skewed, near=lambda w, b=before, a=after: F.collect_list("row").over(w.rowsBetween(-b, a)))
        assert sorted(tuple(map(str, x)) for x in got.select("row", "near").collect()) == expected


def test_a_hot_key_is_many_tasks(skewed, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 100)
    dealt = ranges.in_ranges(skewed, ["site"], ["at", "row"])
    cells = dealt.frame.where("site = 'hot'").groupBy(ranges.RANGE).count().collect()
    assert len(cells) >= 28 and max(c["count"] for c in cells) <= 150
    lags = timeseries.lag_windows(skewed, ["x"], 3, ["site"], ["at", "row"])
    plan = lags._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "site" in plan and ranges.RANGE in plan
    n = lags.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    lags.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lags.where("site = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        lags.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n)
    assert len(tasks) == int(lags.sparkSession.conf.get("spark.sql.shuffle.partitions")) and max(t["count"] for t in tasks) < 0.6 * 2700


@pytest.mark.parametrize("rows_per_range", [3, 1 << 20])
def test_no_rows_one_row_and_equal_values(spark, rows_per_range, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", rows_per_range)
    rows = spark.createDataFrame([("a", 1.0, 0)] * 50 + [("b", 2.0, 1), ("b", None, 2)], "site string, v double, row int")
    assert stats.rank_statistic(rows.limit(0), ["site"], "v", 0.1).count() == 0
    got = {r["site"]: (r["n"], r["q_hat"]) for r in stats.rank_statistic(rows, ["site"], "v", 0.1).collect()}
    assert got == {"a": (50, 1.0), "b": (1, None)}
    ranks = stats.average_rank(rows, ["site"], F.col("v")).collect()
    assert sorted(r["rank"] for r in ranks) == [1, 2] + [25.5] * 50
    assert timeseries.ramp(rows.limit(0), "v", ["site"], ["row"]).count() == 0


def test_only_numbers_cut_ranges(spark):
    rows = spark.createDataFrame([("a", "t")], "site string, name string")
    with pytest.raises(TypeError):
        ranges.in_ranges(rows, ["site"], ["name"])


def test_evenly_timed_rows_are_those_of_a_plain_loop(spark, monkeypatch):
    """Against the rule said in loops: each time takes the nearest row that is left and leaves enough for the later times."""
    r = np.random.default_rng(4)
    times = {k: sorted(r.integers(0, 400 if k % 2 else 12, 60).tolist()) for k in range(6)}
    quotas = {0: 1, 1: 7, 2: 13, 3: 59, 4: 60, 5: 25}
    rows = [(k, 100 * k + n, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), quotas[k]) for k, own in times.items() for n, t in enumerate(own)]
    frame = spark.createDataFrame(rows, "site int, raw_row long, ts timestamp_ntz, quota long")
    expected = set()
    for k, own in times.items():
        n, w = len(own), quotas[k]
        ticks, done = [t * 10**9 for t in own], -1
        for j in range(w):
            aim = ticks[0] + ((ticks[-1] - ticks[0]) // 2 if w == 1 else (ticks[-1] - ticks[0]) * j // (w - 1))
            done = min(range(done + 1, n - w + j + 1), key=lambda p, a=aim, t=ticks: (abs(t[p] - a), t[p], p))
            expected.add(100 * k + done)
    for size in (1 << 18, 9):
        monkeypatch.setattr(ranges, "ROWS_PER_RANGE", size)
        found = [x.raw_row for x in timeseries.evenly_timed(frame, ["site"], "ts", "quota").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_evenly_timed_looks_ahead_over_no_whole_key(spark):
    """A frame up to the end of a key is gone through again for each of its rows."""
    frame = spark.range(50).selectExpr("1 AS site", "id AS raw_row", "timestamp_seconds(id) AS ts", "5L AS quota")
    plan = timeseries.evenly_timed(frame, ["site"], "ts", "quota")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and not re.search(r"Frame, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan)
