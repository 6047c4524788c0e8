"""Lag windows, episodes, segments, splits, samples and event screening."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.functions import scalar as fx
from galeframe.operators import screening as sc
from galeframe.operators import timeseries as ts
from galeframe.operators.quantiles import exact_percentiles
from galeframe.plans.registry import query, r
from galeframe.plans.scalars import _SPLIT_SQL
from galeframe.sources.schema import SERIES_SQL, Protocol, site_series

#: A regular 15-minute grid from the irregular events: first reading of each interval.
GRID_SQL = f"""WITH {SERIES_SQL}, grid AS (SELECT site, time_bucket(INTERVAL '15 minutes', ts) AS ts, round(avg(power), 6) AS power, round(avg(wind), 6) AS wind, min(raw_row) AS raw_row FROM series GROUP BY ALL)"""


def grid(spark, sf_dir):
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 900) * 900).cast("timestamp_ntz")
    return site_series(spark, sf_dir).groupBy("site", bucket.alias("ts")).agg(F.round(F.avg("power"), 6).alias("power"), F.round(F.avg("wind"), 6).alias("wind"), F.min("raw_row").alias("raw_row"))


def _flat(lags, width):
    """One number that depends on every lag and its place."""
    total = F.lit(0.0)
    for k in range(width):
        total = total + F.coalesce(F.get(lags, F.lit(k)), F.lit(-1.0)) * (k + 1)
    return total


@query(
    "W1_lag_windows",
    f"""WITH {SERIES_SQL}, w AS (SELECT raw_row, list(coalesce(power, -1.0)) OVER o AS p, list(coalesce(wind, -1.0)) OVER o AS q, count(*) OVER o AS n FROM series WINDOW o AS (PARTITION BY site ORDER BY ts, raw_row ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
        SELECT raw_row, round(p[1] + 2 * q[1] + 3 * p[2] + 4 * q[2] + 5 * p[3] + 6 * q[3], 4) + 0.0 AS mark FROM w WHERE n = 3""",
)
def lag_windows(spark, sf_dir):
    rows = ts.lag_windows(site_series(spark, sf_dir), ["power", "wind"], 3, ["site"], ["ts", "raw_row"])
    return rows.select("raw_row", r(_flat(F.col("lags"), 6), 4).alias("mark"))


@query(
    "W2_lag_sequences",
    f"WITH {SERIES_SQL}, w AS (SELECT raw_row, lag(power, 4) OVER o AS oldest, lag(wind, 1) OVER o AS newest, count(*) OVER (PARTITION BY site ORDER BY ts, raw_row ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS n FROM series WINDOW o AS (PARTITION BY site ORDER BY ts, raw_row)) SELECT raw_row, oldest, newest FROM w WHERE n = 4",
)
def lag_sequences(spark, sf_dir):
    rows = ts.lag_windows(site_series(spark, sf_dir), ["power", "wind"], 4, ["site"], ["ts", "raw_row"], flat=False)
    return rows.select("raw_row", F.get(F.get("lags", F.lit(0)), F.lit(0)).alias("oldest"), F.get(F.get("lags", F.lit(3)), F.lit(1)).alias("newest"))


_CONTIGUOUS_SQL = f"""{GRID_SQL}, s AS (SELECT *, coalesce(CAST(ts - lag(ts) OVER o = INTERVAL '15 minutes' AS INTEGER), 0) AS good FROM grid WINDOW o AS (PARTITION BY site ORDER BY ts)),
    w AS (SELECT *, sum(good) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run, lag(power, 3) OVER o AS p3, lag(power, 2) OVER o AS p2, lag(power, 1) OVER o AS p1,
          lag(wind, 3) OVER o AS q3, lag(wind, 2) OVER o AS q2, lag(wind, 1) OVER o AS q1, row_number() OVER o AS rn FROM s WINDOW o AS (PARTITION BY site ORDER BY ts))"""


@query("W4_contiguous_windows", f"{_CONTIGUOUS_SQL} SELECT site, ts, round(p3 + 2 * p2 + 3 * p1, 4) + 0.0 AS mark FROM w WHERE run = 3 AND rn > 3")
def contiguous_windows(spark, sf_dir):
    rows = ts.contiguous_lag_windows(grid(spark, sf_dir), ["power"], 3, 900, ["site"], stretch_days=2)
    return rows.select("site", "ts", r(_flat(F.col("lags"), 3), 4).alias("mark"))


@query("W5_append_lag", f"{_CONTIGUOUS_SQL} SELECT site, ts, round(p3 + 2 * p2 + 3 * p1 + 4 * q3 + 5 * q2 + 6 * q1, 4) + 0.0 AS mark FROM w WHERE run = 3 AND rn > 3")
def append_lag(spark, sf_dir):
    base = grid(spark, sf_dir)
    rows = ts.append_lag(ts.contiguous_lag_windows(base, ["power"], 3, 900, ["site"]), base.select("site", "ts", "wind"), "wind", 3, 900, ["site"])
    return rows.select("site", "ts", r(_flat(F.col("lags"), 6), 4).alias("mark"))


@query("W3_fit_statistics", f"WITH {SERIES_SQL}, u AS (SELECT site, power, max(CAST(ts < TIMESTAMP '2024-01-11' AND raw_row % 5 = 0 AS INT)) OVER (PARTITION BY site ORDER BY ts, raw_row ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS used FROM series) SELECT site, count(*) AS n, round(avg(power), 6) AS mean_value, round(stddev_pop(power), 6) AS scale FROM u WHERE used = 1 GROUP BY site")
def fit_statistics(spark, sf_dir):
    wanted = (F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")) & (F.col("raw_row") % 5 == 0)
    used = ts.rows_of_windows(site_series(spark, sf_dir).withColumn("is_fit", wanted), ["site"], ["ts", "raw_row"], "is_fit", 3)
    return used.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r(F.avg("power")).alias("mean_value"), r(F.stddev_pop("power")).alias("scale"))


@query("W6_append_two_lags", f"{_CONTIGUOUS_SQL} SELECT site, ts, round(p3 + 2 * p2 + 3 * p1 + 4 * q3 + 5 * q2 + 6 * q1 + 7 * 2 * p3 + 8 * 2 * p2 + 9 * 2 * p1, 4) + 0.0 AS mark FROM w WHERE run = 3 AND rn > 3")
def append_two_lags(spark, sf_dir):
    base = grid(spark, sf_dir).withColumn("double", F.col("power") * 2)
    rows = ts.contiguous_lag_windows(base.select("site", "ts", "power"), ["power"], 3, 900, ["site"])
    for column in ("wind", "double"):
        rows = ts.append_lag(rows, base.select("site", "ts", column), column, 3, 900, ["site"])
    return rows.select("site", "ts", r(_flat(F.col("lags"), 9), 4).alias("mark"))


@query("W7_ramp", f"WITH {SERIES_SQL} SELECT raw_row, round(abs(power - coalesce(lag(power) OVER (PARTITION BY site ORDER BY ts, raw_row), power)), 6) + 0.0 AS ramp FROM series")
def ramp(spark, sf_dir):
    return ts.ramp(site_series(spark, sf_dir), "power", ["site"], ["ts", "raw_row"]).select("raw_row", r("ramp").alias("ramp"))


#: Episodes of extreme rows: power above the site's 90th percentile, no more than an hour apart.
_EPISODE_SQL = f"""WITH {SERIES_SQL}, t AS (SELECT site, quantile_cont(power, 0.9) AS high FROM series GROUP BY site), e AS (SELECT series.* FROM series JOIN t USING (site) WHERE power > high),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o <= INTERVAL '1 hour' THEN 0 ELSE 1 END AS new FROM e WINDOW o AS (PARTITION BY site ORDER BY ts, raw_row)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY ts, raw_row ROWS UNBOUNDED PRECEDING) AS run FROM g),
    episodes AS (SELECT site, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows, CAST(sum(CAST(wind > 50 AS INTEGER)) AS BIGINT) AS n_windy FROM i GROUP BY site, run)"""


def _episodes(spark, sf_dir):
    rows = site_series(spark, sf_dir)
    high = exact_percentiles(rows, ["site"], {"high": ("power", 0.9)})
    extreme = rows.join(F.broadcast(high), "site").where("power > high")
    return ts.episodes(extreme, ["site"], "ts", 3600, {"n_windy": F.col("wind") > 50}, at_most=True, stretch_days=1)


@query("W8_episodes", f"{_EPISODE_SQL} SELECT site, start_ts, end_ts, n_rows, n_windy FROM episodes")
def episodes(spark, sf_dir):
    return _episodes(spark, sf_dir)


@query("W8_exact_step_episodes", f"{GRID_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o = INTERVAL '15 minutes' THEN 0 ELSE 1 END AS new FROM grid WINDOW o AS (PARTITION BY site ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT site, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM i GROUP BY site, run")
def exact_step_episodes(spark, sf_dir):
    return ts.episodes(grid(spark, sf_dir), ["site"], "ts", 900, stretch_days=3)


@query("W9_longest_episode", f"{_EPISODE_SQL} SELECT site, start_ts, end_ts, n_rows, n_windy FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n_rows DESC, start_ts) AS k FROM episodes) WHERE k = 1")
def longest_episode(spark, sf_dir):
    return ts.longest_episode(_episodes(spark, sf_dir), ["site"])


@query("G16_episode_durations", f"{_EPISODE_SQL} SELECT site, count(*) AS n, median(n_rows * 0.25) AS median_hours, round(quantile_cont(n_rows * 0.25, 0.95), 6) AS p95_hours, max(n_rows * 0.25) AS max_hours FROM episodes GROUP BY site")
def episode_durations(spark, sf_dir):
    hours = fx.hours(F.col("n_rows"))
    return _episodes(spark, sf_dir).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.median(hours).alias("median_hours"), F.round(F.percentile(hours, 0.95), 6).alias("p95_hours"), F.max(hours).alias("max_hours"))


@query("W10_separate_segments")
def separate_segments(spark, sf_dir):
    w = Window.partitionBy("site")
    rows = site_series(spark, sf_dir).withColumns({"at": F.row_number().over(w.orderBy("ts", "raw_row")) - 1, "n": F.count(F.lit(1)).over(w)})
    return ts.separate_segments(rows.where("power > 90"), ["site"], "at", "n", 5, 12, 24)


@query(
    "W11_widest_segment",
    f"""WITH {SERIES_SQL}, w AS (SELECT site, row_number() OVER o - 1 AS start_at, stddev_pop(power) OVER (PARTITION BY site ORDER BY ts, raw_row ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS d, count(*) OVER (PARTITION BY site) AS n FROM series WINDOW o AS (PARTITION BY site ORDER BY ts, raw_row))
        SELECT site, start_at, least(n, start_at + 50) AS end_at FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(d, 9) DESC, start_at) AS k FROM w WHERE (n > 50 AND start_at % 10 = 0 AND start_at <= n - 50) OR (n <= 50 AND start_at = 0)) WHERE k = 1""",
)
def widest_segment(spark, sf_dir):
    return ts.widest_segment(site_series(spark, sf_dir), ["site"], ["ts", "raw_row"], "power", 50)


@query("W12_neighbourhood", f"WITH {SERIES_SQL}, w AS (SELECT site, raw_row, row_number() OVER (PARTITION BY site ORDER BY ts, raw_row) - 1 AS position FROM series) SELECT site, raw_row, position FROM w WHERE position >= 20 AND position < 40")
def neighbourhood(spark, sf_dir):
    return ts.neighbourhood(site_series(spark, sf_dir), ["site"], ["ts", "raw_row"], 30, 10).select("site", "raw_row", F.col("position").cast("long").alias("position"))


@query(
    "W13_rolling_expansion",
    f"""WITH {SERIES_SQL}, c AS (SELECT *, greatest(10 - power, power - 60, 0.0) AS score, ts >= TIMESTAMP '2024-01-16' AS is_test FROM series),
        w AS (SELECT raw_row, is_test, list_sort(list(score) OVER (PARTITION BY site ORDER BY ts, raw_row ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)) AS past FROM c)
        SELECT raw_row, round(CASE WHEN CAST(ceil((len(past) + 1) * (1 - 0.1)) AS INTEGER) <= len(past) THEN past[CAST(ceil((len(past) + 1) * (1 - 0.1)) AS INTEGER)] END, 6) + 0.0 AS expansion FROM w WHERE is_test""",
)
def rolling_expansion(spark, sf_dir):
    rows = site_series(spark, sf_dir).withColumns({"score": fx.conformal_score(F.col("power"), F.lit(10.0), F.lit(60.0)), "is_test": F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")})
    return ts.rolling_expansion(rows, ["site"], ["ts", "raw_row"], "score", "is_test", 64, 0.1).select("raw_row", r("expansion").alias("expansion"))


@query(
    "W14_evenly_spaced",
    f"""WITH {SERIES_SQL}, w AS (SELECT site, raw_row, row_number() OVER (PARTITION BY site ORDER BY ts, raw_row) - 1 AS pos, count(*) OVER (PARTITION BY site) AS n FROM series),
        want AS (SELECT DISTINCT site, CAST(floor(i * ((n - 1) / 19.0) + 1e-9) AS BIGINT) AS pos FROM w, range(20) t(i) WHERE n > 20) SELECT w.site, w.raw_row FROM w JOIN want USING (site, pos)""",
)
def evenly_spaced(spark, sf_dir):
    return ts.evenly_spaced(site_series(spark, sf_dir), ["site"], ["ts", "raw_row"], 20).select("site", "raw_row")


@query("W15_evenly_timed")
def evenly_timed(spark, sf_dir):
    rows = site_series(spark, sf_dir).select("site", "raw_row", "ts", F.lit(12).cast("long").alias("quota"))
    return ts.evenly_timed(rows, ["site"], "ts", "quota").select("site", "raw_row", "ts")


@query("W16_head", f"WITH {SERIES_SQL} SELECT site, raw_row FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, raw_row) AS k FROM series) WHERE k <= 10")
def head(spark, sf_dir):
    return ts.head(site_series(spark, sf_dir), ["site"], ["ts", "raw_row"], 10).select("site", "raw_row")


@query("W17_positional_split", f"WITH {SERIES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, raw_row) AS k, count(*) OVER (PARTITION BY site) AS n FROM series) SELECT site, CASE WHEN k <= greatest(floor(n * 0.6), 10) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM w GROUP BY ALL")
def positional_split(spark, sf_dir):
    return ts.positional_split(site_series(spark, sf_dir), ["site"], ["ts", "raw_row"], 0.6, 10).groupBy("site", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "W18_shuffled_split",
    f"WITH {SERIES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY md5('42|' || raw_row), raw_row) AS k, count(*) OVER (PARTITION BY site) AS n FROM series), c AS (SELECT *, greatest(floor(n * 0.6), 10) AS cut FROM w) SELECT site, raw_row, CASE WHEN k <= CASE WHEN cut >= n THEN greatest(1, floor(n / 2)) ELSE cut END THEN 'train' ELSE 'test' END AS part FROM c",
)
def shuffled_split(spark, sf_dir):
    return ts.positional_split(site_series(spark, sf_dir), ["site"], ts.hashed_order("raw_row", 42), 0.6, 10, by=ts.hashed_number("raw_row", 42)).select("site", "raw_row", "part")


@query(
    "W19_label_budgets",
    f"WITH {SERIES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY md5('3|' || raw_row), raw_row) AS k FROM series) SELECT site, budget, raw_row FROM w, (VALUES (8), (16), (32)) b(budget) WHERE k <= budget",
)
def label_budgets(spark, sf_dir):
    return ts.label_budgets(site_series(spark, sf_dir), ["site"], "raw_row", 3, [8, 16, 32]).select("site", "budget", "raw_row")


# --- screening

_RAMP_SQL = "abs(power - coalesce(lag(power) OVER (PARTITION BY site ORDER BY ts, raw_row), power))"


def _next_below(value, share):
    """The value on the lower side of a percentile: a row lies above the one where it lies above the other, however interpolation would round."""
    return f"(list({value} ORDER BY {value}) FILTER ({value} IS NOT NULL))[1 + CAST(floor({share}::DOUBLE * (count({value}) - 1)) AS BIGINT)]"


_SCREEN_SQL = f"""WITH {SERIES_SQL}, x AS (SELECT *, {_RAMP_SQL} AS ramp FROM series), t AS (SELECT site, {_next_below("power", 0.95)} AS qp, {_next_below("wind", 0.95)} AS qw, {_next_below("ramp", 0.9)} AS qr FROM x GROUP BY site),
    f AS (SELECT x.*, coalesce(wind > qw, false) OR coalesce(power > qp, false) AS is_stat, coalesce(ramp > qr, false) AS is_ramp, coalesce(wind > 97, false) AS is_cut_out FROM x JOIN t USING (site))"""


def _screened(spark, sf_dir):
    return sc.screen(site_series(spark, sf_dir), sc.Rules(ramp_q=90.0, cut_out=97.0), ties=("raw_row",))


@query("X1_screen", f"{_SCREEN_SQL} SELECT raw_row, is_stat OR is_ramp OR is_cut_out AS is_extreme FROM f")
def screen(spark, sf_dir):
    return _screened(spark, sf_dir).select("raw_row", "is_extreme")


@query("X2_rule_masks", f"{_SCREEN_SQL} SELECT raw_row, is_stat, is_ramp, is_cut_out, false AS is_temp FROM f")
def rule_masks(spark, sf_dir):
    return _screened(spark, sf_dir).select("raw_row", "is_stat", "is_ramp", "is_cut_out", "is_temp")


_TRAIN_SQL = f"WITH {SERIES_SQL}, l AS (SELECT *, {_SPLIT_SQL} AS split, power AS temperature FROM series), t AS (SELECT site, quantile_cont(wind, 0.98) FILTER (split = 'train') AS wind_high, quantile_cont(temperature, 0.02) FILTER (split = 'train') AS temp_low, quantile_cont(temperature, 0.98) FILTER (split = 'train') AS temp_high FROM l GROUP BY site)"


def _labelled(spark, sf_dir):
    return site_series(spark, sf_dir).withColumns({"split": fx.split_label(F.col("ts"), Protocol()), "temperature": F.col("power")})


@query("X3_train_thresholds", f"{_TRAIN_SQL} SELECT site, round(wind_high, 6) AS wind_high, round(temp_low, 6) AS temp_low, round(temp_high, 6) AS temp_high FROM t")
def train_thresholds(spark, sf_dir):
    found = sc.train_thresholds(_labelled(spark, sf_dir), "site", "split")
    return found.select("site", *(F.round(c, 6).alias(c) for c in ("wind_high", "temp_low", "temp_high")))


@query(
    "X4_nested_thresholds",
    f"WITH {SERIES_SQL}, t AS (SELECT site, quantile_cont(wind, 0.9) AS q90, quantile_cont(wind, 0.99) AS q99 FROM series GROUP BY site) SELECT site, count(*) FILTER (wind > q90) AS n_outer, count(*) FILTER (wind > q99) AS n_core, count(*) FILTER (wind > q99 AND NOT wind > q90) AS n_not_nested FROM series JOIN t USING (site) GROUP BY site",
)
def nested_thresholds(spark, sf_dir):
    rows = site_series(spark, sf_dir)
    t = exact_percentiles(rows, ["site"], {"q90": ("wind", 0.9), "q99": ("wind", 0.99)})
    outer, core = F.col("wind") > F.col("q90"), F.col("wind") > F.col("q99")
    return rows.join(F.broadcast(t), "site").groupBy("site").agg(F.count_if(outer).alias("n_outer"), F.count_if(core).alias("n_core"), F.count_if(core & ~outer).alias("n_not_nested"))


@query(
    "X5_rule_overlap",
    f"""{_TRAIN_SQL}, f AS (SELECT l.*, coalesce(wind > wind_high, false) AS w, coalesce(temperature < temp_low, false) AS c, coalesce(temperature > temp_high, false) AS h, coalesce(wind > 97, false) AS o FROM l JOIN t USING (site))
        SELECT site, count(*) FILTER (w AND c) AS wind_cold, count(*) FILTER (w AND h) AS wind_hot, count(*) FILTER (CAST(w AS INT) + CAST(c AS INT) + CAST(h AS INT) + CAST(o AS INT) >= 2) AS two_rules, round(avg(CAST(w OR c OR h OR o AS DOUBLE)), 6) AS union_share FROM f GROUP BY site""",
)
def rule_overlap(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    flagged = sc.apply_thresholds(rows, sc.train_thresholds(rows, "site", "split"), "site", 97.0)
    rules = ("is_wind", "is_cold", "is_hot", "is_cut_out")
    n = sum((F.col(c).cast("int") for c in rules), F.lit(0))
    return flagged.groupBy("site").agg(
        F.count_if(F.col("is_wind") & F.col("is_cold")).alias("wind_cold"), F.count_if(F.col("is_wind") & F.col("is_hot")).alias("wind_hot"), F.count_if(n >= 2).alias("two_rules"), F.round(F.avg(F.col("is_extreme").cast("double")), 6).alias("union_share")
    )


@query(
    "X6_largest_remainder",
    """WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS size FROM orders GROUP BY ALL),
        w AS (SELECT *, size - 1 AS room, sum(size - 1) OVER p AS total, least(100, sum(size) OVER p) - count(*) OVER p AS rest FROM c WINDOW p AS (PARTITION BY y)),
        e AS (SELECT *, (rest * room) // total AS whole, (rest * room) % total AS part FROM w), o AS (SELECT *, rest - sum(whole) OVER (PARTITION BY y) AS over FROM e)
        SELECT y, m, size, CAST(1 + whole + CASE WHEN whole < room AND row_number() OVER (PARTITION BY y ORDER BY whole < room DESC, part DESC, m) <= over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM o""",
)
def largest_remainder(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cells = orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("size"))
    return sc.largest_remainder(cells, ["y"], ["m"], "size", 100)


@query("X6_stratified_labels")
def stratified_labels(spark, sf_dir):
    rows = site_series(spark, sf_dir).withColumns({"month": fx.month_key(F.col("ts")), "event": fx.event_category(F.col("wind") < 10, F.col("wind") > 90)})
    return sc.stratified_labels(rows, ["site"], "month", "event", "ts", 128).select("site", "month", "event", "raw_row", "ts")


@query("G18_census", f"{_SCREEN_SQL}, l AS (SELECT *, {_SPLIT_SQL} AS split, is_stat OR is_ramp OR is_cut_out AS ex FROM f) SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (ex) AS n_target, count(*) FILTER (NOT ex) AS n_source FROM l GROUP BY ROLLUP (split)")
def census(spark, sf_dir):
    rows = _screened(spark, sf_dir).withColumn("split", fx.split_label(F.col("ts"), Protocol()))
    found = rows.rollup("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_extreme").alias("n_target"), F.count_if(~F.col("is_extreme")).alias("n_source"))
    return found.withColumn("split", F.coalesce("split", F.lit("all")))


@query("T29_preparation", f"""{_CONTIGUOUS_SQL}, t AS (SELECT site, quantile_cont(power, 0.9) AS high FROM grid GROUP BY site)
    SELECT site, {_SPLIT_SQL} AS split, power > high AS is_extreme, count(*) AS n, round(avg((p3 + 2 * p2 + 3 * p1)), 4) + 0.0 AS mean_mark FROM w JOIN t USING (site) WHERE run = 3 AND rn > 3 GROUP BY ALL""")
def preparation(spark, sf_dir):
    """The chronological preparation as one plan: grid, contiguous windows, train-free screen, split, domains."""
    base = grid(spark, sf_dir)
    high = exact_percentiles(base, ["site"], {"high": ("power", 0.9)})
    rows = ts.contiguous_lag_windows(base, ["power"], 3, 900, ["site"]).join(F.broadcast(high), "site")
    return rows.groupBy("site", fx.split_label(F.col("ts"), Protocol()).alias("split"), (F.col("power") > F.col("high")).alias("is_extreme")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(_flat(F.col("lags"), 3)), 4).alias("mean_mark"))
