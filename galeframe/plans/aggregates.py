"""Aggregates, quantiles, distances, ranks and summaries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.functions import scalar as fx
from galeframe.operators import inference as inf
from galeframe.operators import stats as st
from galeframe.plans.registry import query, r
from galeframe.sources.schema import CAPACITY_SQL, FORECASTS_SQL, SERIES_SQL, capacities, forecasts, site_series, table

_RMSE_SQL = f"WITH {FORECASTS_SQL}, runs AS (SELECT task, site, method, seed, sqrt(avg(pow(prediction - y, 2))) AS rmse FROM forecasts GROUP BY ALL)"


def _runs(spark, sf_dir):
    return forecasts(spark, sf_dir).groupBy("task", "site", "method", "seed").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).alias("rmse"))


@query("G1_seed_summary", f"{_RMSE_SQL} SELECT task, method, count(*) AS n, round(avg(rmse), 6) AS mean_value, round(min(rmse), 6) AS min_value, round(max(rmse), 6) AS max_value, round(stddev_samp(rmse), 6) AS sd_value FROM runs GROUP BY ALL")
def seed_summary(spark, sf_dir):
    found = st.summary(_runs(spark, sf_dir), ["task", "method"], "rmse")
    return found.select("task", "method", "n", *(F.round(c, 6).alias(c) for c in ("mean_value", "min_value", "max_value", "sd_value")))


@query("G2_named_aggregates", f"{_RMSE_SQL} SELECT method, count(DISTINCT site) AS sites, round(avg(rmse), 6) AS macro FROM runs GROUP BY method")
def named_aggregates(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("method").agg(F.count_distinct("site").alias("sites"), r(F.avg("rmse")).alias("macro"))


@query("G3_filtered_mean", f"WITH {SERIES_SQL} SELECT site, event_type, round(avg(power), 6) AS mean_power FROM series WHERE event_type <> 'error' GROUP BY ALL ORDER BY site, event_type")
def filtered_mean(spark, sf_dir):
    return site_series(spark, sf_dir).where("event_type <> 'error'").groupBy("site", "event_type").agg(r(F.avg("power")).alias("mean_power")).orderBy("site", "event_type")


@query(
    "G4_loglog_fit",
    "SELECT l_returnflag, round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 6) AS slope, round(regr_intercept(log10(l_extendedprice), log10(l_quantity)), 6) AS intercept, round(regr_r2(log10(l_extendedprice), log10(l_quantity)), 6) AS r2, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY ALL HAVING count(*) >= 2",
)
def loglog_fit(spark, sf_dir):
    found = st.loglog_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return found.select("l_returnflag", *(r(c).alias(c) for c in ("slope", "intercept", "r2")), "n")


@query("G5_percentiles", f"WITH {SERIES_SQL} SELECT site, round(quantile_cont(power, 0.02), 6) AS p02, round(quantile_cont(power, 0.5), 6) AS p50, round(quantile_cont(power, 0.98), 6) AS p98 FROM series GROUP BY site")
def percentiles(spark, sf_dir):
    found = st.percentiles(site_series(spark, sf_dir), ["site"], "power", {"p02": 0.02, "p50": 0.5, "p98": 0.98})
    return found.select("site", *(F.round(c, 6).alias(c) for c in ("p02", "p50", "p98")))


def _scores(spark, sf_dir):
    return forecasts(spark, sf_dir).withColumn("score", fx.conformal_score(F.col("y"), F.col("lower"), F.col("upper")))


_SCORE_SQL = f"WITH {FORECASTS_SQL}, s AS (SELECT task, greatest(lower - y, y - upper, 0.0) AS score FROM forecasts), k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score) AS at, count(*) OVER (PARTITION BY task) AS n FROM s)"


@query("G6_conformal_rank", f"{_SCORE_SQL} SELECT task, max(n) AS n, round(max(CASE WHEN k.at = ceil((k.n + 1) * (1 - 0.05)) THEN score END), 6) AS q_hat FROM k GROUP BY task")
def conformal_rank(spark, sf_dir):
    return st.rank_statistic(_scores(spark, sf_dir), ["task"], "score", 0.05).select("task", "n", F.round("q_hat", 6).alias("q_hat"))


@query("G7_conformal_higher", f"{_SCORE_SQL} SELECT task, max(n) AS n, round(max(CASE WHEN k.at = ceil((k.n - 1) * (1 - 0.1)) + 1 THEN score END), 6) AS q_hat FROM k GROUP BY task")
def conformal_higher(spark, sf_dir):
    return st.rank_statistic(_scores(spark, sf_dir), ["task"], "score", 0.1, finite_sample=False).select("task", "n", F.round("q_hat", 6).alias("q_hat"))


@query(
    "G8_weighted_quantile",
    "WITH v AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS up, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM v) SELECT l_returnflag, min(v) AS quantile FROM c WHERE up >= 0.3 * total GROUP BY ALL",
)
def weighted_quantile(spark, sf_dir):
    return st.weighted_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.3)


_HISTOGRAM_SQL = f"""WITH {SERIES_SQL}, h AS (SELECT site, CAST(least(floor((power - 0) / 5.0), 19) AS INTEGER) AS bin, count(*) AS n FROM series WHERE power >= 0 AND power <= 100 GROUP BY ALL),
    g AS (SELECT site, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT site FROM series), range(20) t(b)), f AS (SELECT site, bin, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (site, bin)),
    d AS (SELECT *, n / (sum(n) OVER (PARTITION BY site) * 5.0) AS density FROM f)"""


@query("G9_histogram", f"{_HISTOGRAM_SQL} SELECT site, bin, n, round(density, 9) + 0.0 AS density FROM d")
def histogram(spark, sf_dir):
    return st.histogram(site_series(spark, sf_dir), ["site"], "power", 20, 0.0, 100.0).select("site", "bin", F.col("n").cast("long").alias("n"), r("density", 9).alias("density"))


def _taps():
    raw = [math.exp(-0.5 * (k / (7 / 3)) ** 2) for k in range(-3, 4)]
    return [t / sum(raw) for t in raw]


_SMOOTH_SQL = " + ".join(f"{t!r} * coalesce({'lag' if k < 0 else 'lead'}(density, {abs(k)}) OVER o, 0)" if k else f"{t!r} * density" for k, t in zip(range(-3, 4), _taps(), strict=True))


@query("G10_smoothing", f"{_HISTOGRAM_SQL} SELECT site, bin, round({_SMOOTH_SQL}, 9) + 0.0 AS smoothed FROM d WINDOW o AS (PARTITION BY site ORDER BY bin)")
def smoothing(spark, sf_dir):
    return st.smooth(st.histogram(site_series(spark, sf_dir), ["site"], "power", 20, 0.0, 100.0), ["site"], "bin", "density").select("site", "bin", r("smoothed", 9).alias("smoothed"))


@query(
    "G11_density_estimate",
    f"""WITH {SERIES_SQL}, b AS (SELECT site, stddev_samp(power) * pow(count(power), -0.2) AS h FROM series GROUP BY site), g AS (SELECT CAST(range AS DOUBLE) * 4 AS grid_at FROM range(25))
        SELECT site, grid_at AS at, round(avg(exp(-0.5 * pow((grid_at - power) / h, 2)) / (h * sqrt(2 * pi()))), 9) + 0.0 AS density FROM series JOIN b USING (site), g WHERE power IS NOT NULL AND h > 0 GROUP BY ALL""",
)
def density_estimate(spark, sf_dir):
    return st.density_estimate(site_series(spark, sf_dir), ["site"], "power", [4.0 * k for k in range(25)]).select("site", "at", r("density", 9).alias("density"))


_DISTANCE_SQL = f"""WITH {SERIES_SQL}, c AS (SELECT site, power, count(*) FILTER (NOT wind > 50) AS a, count(*) FILTER (wind > 50) AS b FROM series WHERE power IS NOT NULL GROUP BY ALL),
    d AS (SELECT site, abs(sum(a) OVER u / sum(a) OVER p - sum(b) OVER u / sum(b) OVER p) AS gap, coalesce(lead(power) OVER (PARTITION BY site ORDER BY power) - power, 0) AS step
          FROM c WINDOW p AS (PARTITION BY site), u AS (PARTITION BY site ORDER BY power ROWS UNBOUNDED PRECEDING))"""


def _distance(spark, sf_dir):
    return st.distribution_distance(site_series(spark, sf_dir).withColumn("is_target", F.col("wind") > 50), ["site"], "power", "is_target")


@query("G12_wasserstein", f"{_DISTANCE_SQL} SELECT site, round(sum(gap * step), 6) + 0.0 AS wasserstein FROM d GROUP BY site")
def wasserstein(spark, sf_dir):
    return _distance(spark, sf_dir).select("site", r("wasserstein").alias("wasserstein"))


@query("G13_kolmogorov_smirnov", f"{_DISTANCE_SQL} SELECT site, round(max(gap), 9) + 0.0 AS ks FROM d GROUP BY site")
def kolmogorov_smirnov(spark, sf_dir):
    return _distance(spark, sf_dir).select("site", r("ks", 9).alias("ks"))


@query(
    "G14_residual_moments",
    f"""WITH {FORECASTS_SQL}, e AS (SELECT task, prediction - y AS e FROM forecasts), m AS (SELECT task, avg(e) AS m, stddev_pop(e) AS sd FROM e GROUP BY task)
        SELECT task, round(any_value(m), 6) + 0.0 AS mean_e, round(any_value(sd), 6) AS sd_e, round(avg(pow(e - m, 3)) / pow(any_value(sd), 3), 6) + 0.0 AS skew_e, round(avg(pow(e - m, 4)) / pow(any_value(sd), 4) - 3, 6) + 0.0 AS kurt_e,
               round(quantile_cont(abs(e), 0.95), 6) AS abs_p95, round(avg(CAST(abs(e) > 19.2 AS DOUBLE)), 6) AS tail_share FROM e JOIN m USING (task) GROUP BY task""",
)
def residual_moments(spark, sf_dir):
    rows = forecasts(spark, sf_dir).withColumn("e", F.col("prediction") - F.col("y"))
    return st.residual_moments(rows, ["task"], "e", 0.2 * 96).select("task", *(r(c).alias(c) for c in ("mean_e", "sd_e", "skew_e", "kurt_e", "abs_p95", "tail_share")))


@query("G15_shares", f"WITH {SERIES_SQL} SELECT site, count(*) FILTER (wind > 50) AS n_windy, count(*) FILTER (wind > 50 AND power > 50) AS n_both, round(avg(CAST(wind > 50 AS DOUBLE)), 6) AS share FROM series GROUP BY site")
def shares(spark, sf_dir):
    windy = F.col("wind") > 50
    return site_series(spark, sf_dir).groupBy("site").agg(F.count_if(windy).alias("n_windy"), F.count_if(windy & (F.col("power") > 50)).alias("n_both"), F.round(F.avg(windy.cast("double")), 6).alias("share"))


@query(
    "G17_seasonal_composition",
    "SELECT o_orderpriority, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS percent FROM orders GROUP BY 1, 2",
)
def seasonal_composition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", fx.season(F.col("o_orderdate")).alias("season")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority")), 6))


@query("G19_block_sums", f"WITH {FORECASTS_SQL} SELECT task, CAST(floor(date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS block, round(sum(pow(prediction - y, 2)), 3) AS block_sum, count(*) AS block_n FROM forecasts GROUP BY ALL")
def block_sums(spark, sf_dir):
    found = inf.block_sums(forecasts(spark, sf_dir), ["task"], fx.week_block(F.col("ts")), F.pow(F.col("prediction") - F.col("y"), 2))
    return found.select("task", "block", F.round("block_sum", 3).alias("block_sum"), "block_n")


_RANK_SQL = f"{_RMSE_SQL}, m AS (SELECT task, method, round(avg(rmse), 1) AS rmse FROM runs GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY rmse) + (count(*) OVER (PARTITION BY task, rmse) - 1) / 2.0 AS task_rank FROM m)"


def _ranked(spark, sf_dir):
    means = _runs(spark, sf_dir).groupBy("task", "method").agg(F.round(F.avg("rmse"), 1).alias("rmse"))
    return st.average_rank(means, ["task"], F.col("rmse"), "task_rank")


@query("G20_average_ranks", f"{_RANK_SQL} SELECT task, method, rmse, task_rank FROM k")
def average_ranks(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query("G21_wins", f"{_RANK_SQL} SELECT method, count(*) FILTER (task_rank = 1) AS wins, round(avg(task_rank), 6) AS mean_rank FROM k GROUP BY method")
def wins(spark, sf_dir):
    return _ranked(spark, sf_dir).groupBy("method").agg(F.count_if(F.col("task_rank") == 1).alias("wins"), F.round(F.avg("task_rank"), 6).alias("mean_rank"))


@query("G22_site_mean", f"{_RMSE_SQL}, {CAPACITY_SQL}, m AS (SELECT site, method, avg(rmse) AS rmse FROM runs GROUP BY ALL) SELECT method, round(100 * avg(rmse / capacity), 6) AS macro_percent, count(DISTINCT site) AS sites FROM m JOIN capacity USING (site) GROUP BY method")
def site_mean(spark, sf_dir):
    means = _runs(spark, sf_dir).groupBy("site", "method").agg(F.avg("rmse").alias("rmse"))
    return st.site_mean(means, ["method"], "site", "rmse", capacities(spark)).select("method", F.round("macro_percent", 6).alias("macro_percent"), "sites")


@query("G23_search_totals", "SELECT o_orderpriority AS scope, count(*) AS attempts, CAST(sum(l_linenumber) AS BIGINT) AS iterations, round(sum(l_quantity) / 3600, 6) AS hours FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def search_totals(spark, sf_dir):
    """Totals over nested records: each order holds its attempts as a list, as result files do."""
    attempts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("attempts"))
    nested = table(spark, sf_dir, "orders").join(attempts, F.col("o_orderkey") == F.col("l_orderkey"))
    flat = nested.select(F.col("o_orderpriority").alias("scope"), F.explode("attempts").alias("a"))
    return flat.groupBy("scope").agg(F.count(F.lit(1)).alias("attempts"), F.sum("a.l_linenumber").cast("long").alias("iterations"), F.round(F.sum("a.l_quantity") / 3600, 6).alias("hours"))


@query("G24_agreement", f"WITH {FORECASTS_SQL} SELECT task, count(DISTINCT site) = 1 AS agree FROM forecasts GROUP BY task")
def agreement(spark, sf_dir):
    return forecasts(spark, sf_dir).groupBy("task").agg((F.count_distinct("site") == 1).alias("agree"))


@query("G25_signal_power", "WITH e AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT CAST(pos AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 6) AS power FROM e GROUP BY ALL")
def signal_power(spark, sf_dir):
    return st.signal_power(table(spark, sf_dir, "embeddings"), "embedding").select("pos", F.round("power", 6).alias("power"))


_CORR_SQL = "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), c AS (SELECT CAST(pos AS INTEGER) AS pos, corr(CAST(x AS DOUBLE), CAST(label AS DOUBLE)) AS r FROM e GROUP BY ALL)"


@query("G26_feature_correlation", f"{_CORR_SQL} SELECT pos, round(r, 6) + 0.0 AS r FROM c")
def feature_correlation(spark, sf_dir):
    return st.feature_correlation(table(spark, sf_dir, "embeddings"), "embedding", "label").select("pos", r("r").alias("r"))


@query("G26_selected_features", f"{_CORR_SQL} SELECT pos FROM c ORDER BY abs(r) DESC, pos DESC LIMIT 8")
def selected_features(spark, sf_dir):
    return st.select_features(st.feature_correlation(table(spark, sf_dir, "embeddings"), "embedding", "label"), 0.999, 8).select("pos")


@query("G27_mad_scale", f"WITH {FORECASTS_SQL} SELECT task, round(1.4826 * median(abs(prediction - y)), 6) AS scale FROM forecasts GROUP BY task")
def mad_scale(spark, sf_dir):
    rows = forecasts(spark, sf_dir).withColumn("e", F.col("prediction") - F.col("y"))
    return st.mad_scale(rows, ["task"], "e").select("task", F.round("scale", 6).alias("scale"))


@query("G28_mean_impute", f"WITH {SERIES_SQL}, g AS (SELECT *, CASE WHEN raw_row % 9 = 0 THEN NULL ELSE power END AS p FROM series) SELECT raw_row, round(coalesce(p, avg(p) OVER (PARTITION BY site), 0), 6) AS filled FROM g")
def mean_impute(spark, sf_dir):
    rows = site_series(spark, sf_dir).withColumn("p", F.when(F.col("raw_row") % 9 != 0, F.col("power")))
    return st.mean_impute(rows, ["site"], "p", "filled").select("raw_row", F.round("filled", 6).alias("filled"))


@query(
    "G29_balanced_moments",
    f"""WITH {SERIES_SQL}, d AS (SELECT site, avg(power) FILTER (NOT wind > 80) AS ms, avg(power) FILTER (wind > 80) AS mt, avg(power * power) FILTER (NOT wind > 80) AS qs, avg(power * power) FILTER (wind > 80) AS qt FROM series GROUP BY site)
        SELECT site, round((ms + mt) / 2, 6) AS mean_value, round(sqrt((qs + qt) / 2 - pow((ms + mt) / 2, 2)), 6) AS scale FROM d""",
)
def balanced_moments(spark, sf_dir):
    rows = site_series(spark, sf_dir).withColumn("is_target", F.col("wind") > 80)
    return st.balanced_moments(rows, ["site"], "power", "is_target").select("site", F.round("mean_value", 6).alias("mean_value"), F.round("scale", 6).alias("scale"))


@query("G30_pooled_moments", f"WITH {SERIES_SQL} SELECT site, round(avg(power), 6) AS mean_value, round(CASE WHEN stddev_pop(power) = 0 THEN 1 ELSE stddev_pop(power) END, 6) AS scale FROM series GROUP BY site")
def pooled_moments(spark, sf_dir):
    scale = F.stddev_pop("power")
    return site_series(spark, sf_dir).groupBy("site").agg(F.round(F.avg("power"), 6).alias("mean_value"), F.round(F.when(scale == 0, 1.0).otherwise(scale), 6).alias("scale"))


@query("G32_seed_mean_rmse", f"{_RMSE_SQL} SELECT task, method, round(avg(rmse), 6) AS rmse, count(*) AS runs FROM runs GROUP BY ALL")
def seed_mean_rmse(spark, sf_dir):
    return st.squared_errors(forecasts(spark, sf_dir)).select("task", "method", F.round("rmse", 6).alias("rmse"), "runs")


@query("G33_strict_summary", f"{_RMSE_SQL} SELECT method, count(*) AS n, count(*) - count(rmse) AS n_null, round(avg(rmse), 6) AS mean_value FROM runs GROUP BY method")
def strict_summary(spark, sf_dir):
    """Either all runs have the metric or none has it; anything between is an error."""
    n_null = F.count_if(F.col("rmse").isNull())
    found = _runs(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"), n_null.alias("n_null"), F.avg("rmse").alias("mean_value"))
    checked = F.when(~F.col("n_null").isin(0) & (F.col("n_null") != F.col("n")), F.raise_error(F.lit("a metric is there for some runs only"))).otherwise(F.col("mean_value"))
    return found.select("method", "n", "n_null", F.round(checked.cast("double"), 6).alias("mean_value"))


@query("G35_convergence_census", "SELECT o_orderstatus, count(*) AS fits, count(*) FILTER (o_totalprice < 200000) AS converged, max(o_totalprice) AS max_gap, median(o_totalprice) AS median_gap FROM orders GROUP BY ALL")
def convergence_census(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counted = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("fits"), F.count_if(F.col("o_totalprice") < 200000).alias("converged"), F.max("o_totalprice").alias("max_gap"))
    return counted.join(st.percentiles(orders, ["o_orderstatus"], "o_totalprice", {"median_gap": 0.5}), "o_orderstatus")


@query(
    "G36_relation_counts",
    f"{_RMSE_SQL}, m AS (SELECT task, method, avg(rmse) AS rmse FROM runs GROUP BY ALL) SELECT b.method, count(*) FILTER (a.rmse < b.rmse) AS n_lower, count(*) FILTER (a.rmse > b.rmse) AS n_higher, count(*) FILTER (a.rmse = b.rmse) AS n_equal FROM m a JOIN m b USING (task) WHERE a.method = 'A' AND b.method <> 'A' GROUP BY b.method",
)
def relation_counts(spark, sf_dir):
    means = _runs(spark, sf_dir).groupBy("task", "method").agg(F.avg("rmse").alias("rmse"))
    own = means.where("method = 'A'").select("task", F.col("rmse").alias("own"))
    return means.where("method <> 'A'").join(own, "task").groupBy("method").agg(F.count_if(F.col("own") < F.col("rmse")).alias("n_lower"), F.count_if(F.col("own") > F.col("rmse")).alias("n_higher"), F.count_if(F.col("own") == F.col("rmse")).alias("n_equal"))


@query("G37_wall_clock", f"WITH {SERIES_SQL} SELECT site, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS seconds FROM series GROUP BY site")
def wall_clock(spark, sf_dir):
    second = lambda c: F.unix_seconds(c.cast("timestamp"))
    return site_series(spark, sf_dir).groupBy("site").agg((second(F.max("ts")) - second(F.min("ts"))).alias("seconds"))
