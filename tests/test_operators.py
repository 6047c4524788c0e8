import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe.functions import scalar as fx
from galeframe.operators import inference, joins, learning, metrics, screening, stats, timeseries
from galeframe.sources import schema
from galeframe.streaming.conformal import rank_of, stream_expansions

from .whole_fits import pinball_fit

START = dt.datetime(2024, 1, 1)


def series(spark, minutes, values=None):
    rows = [(0, k, START + dt.timedelta(minutes=m), float(values[k]) if values is not None and values[k] is not None else None if values is not None else float(k)) for k, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "site int, raw_row long, ts timestamp_ntz, power double")


def test_windows_need_exact_steps_across_stretches(spark):
    minutes = [15 * k for k in range(300) if k not in (40, 41, 200)]
    found = timeseries.contiguous_lag_windows(series(spark, minutes), ["power"], 4, 900, ["site"], stretch_days=1).collect()
    expected = {k: [float(x) for x in range(k - 4, k)] for k in range(4, len(minutes)) if all(minutes[j] - minutes[j - 1] == 15 for j in range(k - 3, k + 1))}
    assert {r.raw_row: r.lags for r in found} == expected


def test_missing_values_keep_their_place_in_a_window(spark):
    found = timeseries.lag_windows(series(spark, [0, 15, 30, 45], [1, None, 3, 4]), ["power"], 3, ["site"], ["ts"]).collect()
    assert [r.lags for r in found] == [[1.0, None, 3.0]]


def test_episodes_merge_across_stretches(spark):
    minutes = [15 * k for k in range(400) if k % 150 not in (0, 1)]
    found = timeseries.episodes(series(spark, minutes), ["site"], "ts", 900, stretch_days=1).orderBy("start_ts").collect()
    assert [r.n_rows for r in found] == [148, 148, 98]


def test_longest_episode_prefers_the_earliest(spark):
    found = timeseries.episodes(series(spark, [0, 15, 100, 115, 200]), ["site"], "ts", 900)
    assert timeseries.longest_episode(found, ["site"]).first().start_ts == START


def test_separate_segments_are_greedy(spark):
    rows = spark.createDataFrame([(0, p, 100) for p in (1, 5, 14, 15, 40, 98)], "site int, at long, n long")
    found = timeseries.separate_segments(rows, ["site"], "at", "n", 10, 4, 8).orderBy("event_at").collect()
    assert [(r.event_at, r.start_at, r.end_at) for r in found] == [(1, 0, 10), (14, 10, 23), (40, 36, 49), (98, 94, 100)]


def test_evenly_timed_takes_distinct_nearest_rows(spark):
    rows = series(spark, [0, 1, 2, 50, 100]).withColumn("quota", F.lit(3).cast("long"))
    assert [r.raw_row for r in timeseries.evenly_timed(rows, ["site"], "ts", "quota").orderBy("ts").collect()] == [0, 3, 4]


def test_rolling_expansion_uses_the_past_only(spark):
    r = np.random.default_rng(1)
    scores = r.random(60)
    rows = series(spark, [15 * k for k in range(60)], scores).withColumns({"score": F.col("power"), "is_test": F.col("raw_row") >= 30})
    found = {x.raw_row: x.expansion for x in timeseries.rolling_expansion(rows, ["site"], ["ts"], "score", "is_test", 20, 0.1).collect()}
    for k in range(30, 60):
        past = sorted(scores[k - 20 : k])
        assert found[k] == pytest.approx(past[math.ceil(21 * 0.9) - 1])


def test_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    frame = pd.DataFrame({"site": [k % 2 for k in range(80)], "raw_row": range(80), "ts": [START + dt.timedelta(minutes=k) for k in range(80)], "score": r.random(80)})
    spark.createDataFrame(frame, "site int, raw_row long, ts timestamp_ntz, score double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site int, raw_row long, ts timestamp_ntz, score double").parquet(str(tmp_path / "in"))
    job = stream_expansions(stream, 10, 0.2).writeStream.format("memory").queryName("expansions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    job.processAllAvailable()
    job.stop()
    found = {x.raw_row: x.expansion for x in spark.table("expansions").collect()}
    for site in (0, 1):
        own = frame[frame.site == site]
        for k, row in enumerate(own.itertuples()):
            expected = rank_of(own["score"].tolist()[max(0, k - 10) : k], 0.2)
            assert (expected is None and (found[row.raw_row] is None or math.isnan(found[row.raw_row]))) or found[row.raw_row] == pytest.approx(expected)


def test_allocation_is_exact(spark):
    cells = spark.createDataFrame([("a", m, n) for m, n in ((1, 7), (2, 7), (3, 1), (4, 30))], "k string, m int, size long")
    found = {r.m: r.quota for r in screening.largest_remainder(cells, ["k"], ["m"], "size", 20).collect()}
    assert sum(found.values()) == 20 and found[3] == 1
    assert all(found[m] <= n for m, n in ((1, 7), (2, 7), (3, 1), (4, 30)))
    with pytest.raises(Exception, match="budget below"):
        screening.largest_remainder(cells, ["k"], ["m"], "size", 3).collect()


def test_screen_treats_missing_values_as_normal(spark):
    rows = series(spark, [15 * k for k in range(6)], [1, None, 1, 1, 9, 1]).withColumns({"wind": F.col("power") * 2, "temperature": F.lit(0.0)})
    found = screening.screen(rows, screening.Rules(stat_q=80, ramp_ratio=100)).orderBy("ts").collect()
    assert [r.is_extreme for r in found] == [False, False, False, False, True, False]


def test_hour_24_and_bad_times(spark):
    rows = spark.createDataFrame([(" 2019-12-31 24:00 ",), ("2020-02-28 24:00:00.0",), ("2020-01-01 01:30:00",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(fx.parse_timestamp(F.col("t"))).collect()] == [dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 29), dt.datetime(2020, 1, 1, 1, 30), None, None]


def test_columns_are_resolved_by_name():
    assert schema.find_column(["Wind Speed (m/s)", "Power (MW)"], "power") == "Power (MW)"
    with pytest.raises(ValueError, match="Hub height"):
        schema.resolve_columns(["Time"], {"t": "time", "h": "Hub height"})
    with pytest.raises(ValueError):
        schema.Protocol(boundaries=("2024-01-02", "2024-01-01", "2024-01-03", "2024-01-04", "2024-01-05"))


@pytest.mark.parametrize("scheme", ["domain_balanced", "sample_equal", "historical_ratio", "target_10x"])
def test_loss_weights_keep_the_total(scheme):
    source, target = fx.loss_weights(30, 7, 1.5, scheme)
    assert source * 30 + target * 7 == pytest.approx(1.5)
    assert fx.loss_weights(0, 5, 1.0, scheme) == (0.0, 0.2)


def test_noise_does_not_depend_on_partitions(spark):
    rows = spark.range(1000).withColumn("x", F.lit(0.0))
    noisy = lambda n: {r.id: r.e for r in rows.repartition(n).select("id", fx.add_noise(F.col("x"), F.lit(2.0), F.col("id"), 3).alias("e")).collect()}
    a = noisy(2)
    assert a == noisy(7)
    assert np.std(list(a.values())) == pytest.approx(2.0, rel=0.1)


def test_alignment_fails_closed(spark):
    a, b = spark.range(3).withColumn("v", F.lit(1.0)), spark.range(1, 4).withColumn("v", F.lit(1.0))
    with pytest.raises(Exception, match="same keys"):
        joins.aligned(a, b, ["id"], "v").collect()


def test_unordered_bounds_fail(spark):
    rows = spark.createDataFrame([("t", 1.0, 2.0, 0.0)], "task string, y double, lower double, upper double")
    with pytest.raises(Exception, match="above upper"):
        metrics.strict_interval_scores(rows, ["task"], 0.1).collect()


def test_holm_keeps_order_and_cap(spark):
    rows = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.9])], "family string, k int, p double")
    assert [round(r.p_holm, 6) for r in stats.holm(rows, ["family"], "p", ["k"]).orderBy("k").collect()] == [0.04, 0.09, 0.09, 0.9]


def test_ties_share_ranks(spark):
    rows = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 1.0), ("t", "c", 2.0)], "task string, method string, v double")
    assert [r["rank"] for r in stats.average_rank(rows, ["task"], F.col("v")).orderBy("method").collect()] == [1.5, 1.5, 3.0]


def test_resampling_is_keyed_and_bounded():
    sums, counts = np.array([3.0, 2.0, 4.0, 3.5]), np.array([2.0, 2.0, 2.0, 2.0])
    assert inference.sign_flip_p(sums, counts, 999, 1) == inference.sign_flip_p(sums, counts, 999, 1)
    assert inference.sign_flip_p(sums, counts, 4000, 1) == pytest.approx(2 / 16, abs=0.03)
    values = inference.resampled_ratio(sums, counts, 500, 3)
    assert values.min() >= 1.0 and values.max() <= 2.0
    assert inference.subsample_counts(100, 10, 60, 0.5) == (50, 10)


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_pinball_fit_is_certified(tau):
    r = np.random.default_rng(4)
    z = r.standard_normal((300, 5))
    y = z @ np.arange(5) + r.standard_normal(300)
    found = pinball_fit(z, y, np.full(300, 1 / 300), tau, 0.01)
    assert found.converged and found.primal >= found.dual - 1e-9
    assert np.mean(y <= z @ found.weights + found.intercept) == pytest.approx(tau, abs=0.03)


def test_fit_jobs_use_every_row(spark):
    r = np.random.default_rng(6)
    z = r.standard_normal((9000, 3))
    y = z @ [1.0, -2.0, 0.5] + r.standard_normal(9000)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": range(9000), "z": z.tolist(), "y": y}), "vec_id long, z array<double>, y double")
    jobs = spark.createDataFrame([("low", 0.1, 0), ("mid", 0.5, 1)], "job string, tau double, seed int")
    for found in learning.fit_jobs(rows, jobs, "z", "y", 0.1).collect():
        whole = pinball_fit(z, y, np.full(9000, 1 / 9000), found.tau, 0.1)
        assert found.n == 9000 and found.converged and found.dual <= found.primal
        assert found.primal == pytest.approx(whole.primal, abs=2e-4)
        assert np.allclose(found.weights, whole.weights, atol=0.05)


def test_moments_give_ridge(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    rows = spark.createDataFrame([(a.tolist(), float(b), bool(k % 3 == 0)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x array<double>, y double, t boolean")
    w, b = learning.ridge(learning.moments(rows, "x", "y", "t"), 1e-9)
    assert np.allclose(w, [1, -2, 0.5]) and b == pytest.approx(3)


def test_domain_objective_is_certified_and_equals_its_definition(spark):
    r = np.random.default_rng(8)
    z = r.standard_normal((600, 4)) + np.where(np.arange(600)[:, None] < 400, 0.0, 0.5)
    y, target = z @ [1.0, -1.0, 0.5, 0.0] + r.standard_normal(600), np.arange(600) >= 400
    rows = spark.createDataFrame(pd.DataFrame({"z": z.tolist(), "y": y, "t": target, "cost": np.where(target, 0.4, 0.1)}), "z array<double>, y double, t boolean, cost double")
    found = learning.moments(rows, "z", "y", "t")
    variance, discrepancy = 3.0, 40.0
    quadratic, linear = learning.domain_terms(found, variance, discrepancy)
    w = r.standard_normal(4)
    source, ys = z[~target], y[~target]
    direct = w @ w / 2 + variance / 2 * np.var(ys - source @ w) + discrepancy / 2 * (w @ (source.mean(axis=0) - z[target].mean(axis=0))) ** 2
    assert w @ quadratic @ w / 2 - linear @ w + variance / 2 * np.var(ys) == pytest.approx(direct, rel=1e-9)
    jobs = spark.createDataFrame([("a", 0.2, 0), ("b", 0.7, 0)], "job string, tau double, seed int")
    for fit in learning.fit_jobs(rows, jobs, "z", "y", cost="cost", terms={j: (quadratic, linear) for j in "ab"}).collect():
        whole = pinball_fit(z, y, np.where(target, 0.4, 0.1), fit.tau, quadratic, -linear)
        assert fit.converged and whole.converged and fit.dual <= fit.primal and whole.dual - 1e-6 <= fit.primal
        assert fit.primal == pytest.approx(whole.primal, rel=2e-4)
        assert np.allclose(fit.weights, whole.weights, atol=0.02)


def test_evenly_timed_equals_the_choices_one_by_one(spark):
    r = np.random.default_rng(9)
    cells = {k: np.sort(r.choice([1, 2, 3, 50, 51, 52, 53, *range(200, 400, 7)], size)) for k, size in enumerate([1, 2, 3, 5, 9, 20, 40, 40, 60])}
    quota = {k: [1, 1, 2, 4, 1, 7, 5, 39, 12][k] for k in cells}
    rows = [(k, 1000 * k + i, START + dt.timedelta(minutes=int(m)), quota[k]) for k, ticks in cells.items() for i, m in enumerate(ticks)]
    found = timeseries.evenly_timed(spark.createDataFrame(rows, "site int, raw_row long, ts timestamp_ntz, quota long"), ["site"], "ts", "quota").collect()
    for k, ticks in cells.items():
        wanted = min(quota[k], len(ticks))
        span, expected, floor = int(ticks[-1] - ticks[0]) * 60 * 10**9, [], 0
        aims = [span // 2] if wanted == 1 else [span * j // (wanted - 1) for j in range(wanted)]
        for j, aim in enumerate(aims):
            near = min(range(floor, len(ticks) - (wanted - j) + 1), key=lambda p: (abs(int(ticks[p] - ticks[0]) * 60 * 10**9 - aim), p))
            expected.append(int(near))
            floor = near + 1
        expected = list(range(len(ticks))) if wanted == len(ticks) else expected
        assert sorted(x.raw_row - 1000 * k for x in found if x.site == k) == expected


def test_separate_segments_equal_a_scan(spark):
    r = np.random.default_rng(10)
    events = {k: sorted(r.choice(300, 60, replace=False).tolist()) for k in range(4)}
    rows = spark.createDataFrame([(k, p, 300) for k, at in events.items() for p in at], "site int, at long, n long")
    found = timeseries.separate_segments(rows, ["site"], "at", "n", 5, 12, 24).collect()
    for k, at in events.items():
        expected, last = [], -1
        for p in at:
            start, end = max(0, p - 12), min(300, p + 25)
            if start >= last and end - start >= 18 and len(expected) < 5:
                expected.append((p, start, end))
                last = end
        assert sorted((x.event_at, x.start_at, x.end_at) for x in found if x.site == k) == expected


def test_a_task_measures_few_rows_at_once(spark, monkeypatch):
    """What a task holds beside its batch does not grow with the batch, and the sums are those of the whole."""
    rows = spark.range(3000).selectExpr("array(double(id % 7), double(id % 11)) AS z", "double(id % 5) AS y", "1.0D AS cost").coalesce(1)

    def measure(x, y, cost):
        return np.array([len(x) if len(x) > 1024 else 0, cost @ x[:, 0], cost @ y, cost @ x[:, -1]])

    over, first, target, n = learning._total(rows, measure, 4)
    assert (over, first, target, n) == (0, sum(k % 7 for k in range(3000)), sum(k % 5 for k in range(3000)), 3000)
