"""Point, interval and quantile scores, and choices made by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.functions import scalar as fx
from galeframe.operators import metrics as mx
from galeframe.operators import stats as st
from galeframe.plans.registry import query, r
from galeframe.sources.schema import CAPACITY_SQL, FORECASTS_SQL, capacities, forecasts


def _scored(name: str, keys: list[str], sql: str, make):
    """A query of rounded aggregates over forecasts."""

    @query(name, f"WITH {FORECASTS_SQL} SELECT {', '.join(keys)}, {sql} FROM forecasts GROUP BY {', '.join(keys)}")
    def scored(spark, sf_dir):
        return forecasts(spark, sf_dir).groupBy(*keys).agg(*(r(c).alias(n) for n, c in make().items()))

    return scored


_E = "(prediction - y)"
_scored(
    "M1_point_scores",
    ["task", "method"],
    f"round(sqrt(avg({_E} * {_E})), 6) AS rmse, round(avg(abs({_E})), 6) AS mae, round(100 * avg(abs({_E}) / greatest(abs(y), 1e-6)), 6) AS mape, round(1 - sum({_E} * {_E}) / (var_pop(y) * count(y)), 6) + 0.0 AS r2",
    lambda: mx.point_scores(F.col("y"), F.col("prediction")),
)
_scored(
    "M2_point_scores_review",
    ["task", "seed"],
    f"round(sqrt(avg({_E} * {_E})), 6) AS rmse, round(avg(abs({_E})), 6) AS mae, round(CASE WHEN var_pop(y) * count(y) > 0 THEN 1 - sum({_E} * {_E}) / (var_pop(y) * count(y)) END, 6) + 0.0 AS r2",
    lambda: {k: v for k, v in mx.point_scores(F.col("y"), F.col("prediction")).items() if k != "mape"},
)

_PICP = "avg(CAST(y BETWEEN lower AND upper AS DOUBLE))"
_PINAW = "avg(upper - lower) / nullif(max(y) - min(y), 0)"
_WINKLER = "avg(upper - lower + 2 / 0.1 * (greatest(lower - y, 0.0) + greatest(y - upper, 0.0)))"


def _interval(*names):
    return lambda: {n: mx.interval_scores(F.col("y"), F.col("lower"), F.col("upper"), 0.1)[n] for n in names}


_scored("M4_picp", ["task"], f"round({_PICP}, 6) AS picp", _interval("picp"))
_scored("M5_mpiw", ["task"], "round(avg(upper - lower), 6) AS mpiw", _interval("mpiw"))
_scored("M6_pinaw", ["task"], f"round({_PINAW}, 6) AS pinaw", _interval("pinaw"))
_scored("M7_cwc", ["task"], f"round(CASE WHEN {_PICP} >= 1 - 0.1 THEN {_PINAW} ELSE {_PINAW} * (1 + 0.3 * exp(-2.0 * ({_PICP} - (1 - 0.1)))) END, 6) AS cwc", _interval("cwc"))
_scored("M8_winkler", ["task"], f"round({_WINKLER}, 6) AS winkler", _interval("winkler"))
_scored("M10_pinball", ["method"], "round(avg(greatest(0.1 * (y - lower), (0.1 - 1) * (y - lower))), 6) AS low, round(avg(greatest(0.9 * (y - upper), (0.9 - 1) * (y - upper))), 6) AS high", lambda: {"low": F.avg(fx.pinball(F.col("y"), F.col("lower"), 0.1)), "high": F.avg(fx.pinball(F.col("y"), F.col("upper"), 0.9))})
_scored("G34_mean_quantile_score", ["method"], "round(avg((greatest(0.025 * (y - lower), (0.025 - 1) * (y - lower)) + greatest(0.975 * (y - upper), (0.975 - 1) * (y - upper))) / 2), 6) AS score", lambda: {"score": F.avg((fx.pinball(F.col("y"), F.col("lower"), 0.025) + fx.pinball(F.col("y"), F.col("upper"), 0.975)) / 2)})
_scored("M14_conformal_scores", ["task"], "round(avg(greatest(lower - y, y - upper, 0.0)), 6) AS plain, round(avg(greatest(lower - y, y - upper, 0.0) / greatest(upper - lower, 1e-6)), 6) AS scaled", lambda: {"plain": F.avg(fx.conformal_score(F.col("y"), F.col("lower"), F.col("upper"))), "scaled": F.avg(fx.conformal_score(F.col("y"), F.col("lower"), F.col("upper"), scaled=True))})
_scored("M15_units", ["task"], "round(count(*) * 0.25, 6) AS hours, round(100 * avg(CAST(y > 50 AS DOUBLE)), 6) AS percent", lambda: {"hours": fx.hours(F.count(F.lit(1))), "percent": 100 * F.avg((F.col("y") > 50).cast("double"))})


@query("M3_nrmse", f"WITH {FORECASTS_SQL}, {CAPACITY_SQL}, s AS (SELECT site, method, sqrt(avg(pow(prediction - y, 2))) AS rmse FROM forecasts GROUP BY ALL) SELECT site, method, round(rmse / capacity, 6) AS nrmse FROM s JOIN capacity USING (site)")
def nrmse(spark, sf_dir):
    rmse = forecasts(spark, sf_dir).groupBy("site", "method").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).alias("rmse"))
    return rmse.join(F.broadcast(capacities(spark)), "site").select("site", "method", r(F.col("rmse") / F.col("capacity")).alias("nrmse"))


@query("M9_interval_bundle", f"WITH {FORECASTS_SQL} SELECT task, method, round({_PICP}, 6) AS picp, round(avg(upper - lower), 6) AS mpiw, round({_WINKLER}, 6) AS winkler FROM forecasts GROUP BY ALL")
def interval_bundle(spark, sf_dir):
    found = mx.strict_interval_scores(forecasts(spark, sf_dir), ["task", "method"], 0.1)
    return found.select("task", "method", *(r(c).alias(c) for c in ("picp", "mpiw", "winkler")))


# --- quantile forecasts: five quantiles around the prediction, in rising order after rearrangement

TAUS = [0.025, 0.1, 0.5, 0.9, 0.975]
_OFFSETS = [-12.0, -6.0, 1.0, 6.0, 12.0]


def _quantiles(spark, sf_dir):
    raw = [F.col("prediction") + o * (1 + F.pmod("window_index", F.lit(3))) - (F.lit(8.0) if k == 3 else F.lit(0.0)) for k, o in enumerate(_OFFSETS)]
    return forecasts(spark, sf_dir).withColumns({f"q{k}": c for k, c in enumerate(raw)})


_Q_SQL = f"WITH {FORECASTS_SQL}, q AS (SELECT *, " + ", ".join(f"prediction + {o} * (1 + window_index % 3)" + (" - 8.0" if k == 3 else "") + f" AS q{k}" for k, o in enumerate(_OFFSETS)) + " FROM forecasts), s AS (SELECT *, list_sort([q0, q1, q2, q3, q4]) AS q FROM q)"


def _ordered():
    return fx.rearranged(*(F.col(f"q{k}") for k in range(5)))


def _is_sql(lo, hi, alpha):
    return f"(q[{hi}] - q[{lo}] + 2 / {alpha} * (greatest(q[{lo}] - y, 0.0) + greatest(y - q[{hi}], 0.0)))"


@query("M11_weighted_interval_score", f"{_Q_SQL} SELECT task, round(avg((0.5 * abs(y - q[3]) + 0.05 / 2 * {_is_sql(1, 5, 0.05)} + 0.2 / 2 * {_is_sql(2, 4, 0.2)}) / 2.5), 6) AS wis, round(avg(2 * ({' + '.join(f'greatest({t} * (y - q[{k + 1}]), ({t} - 1) * (y - q[{k + 1}]))' for k, t in enumerate(TAUS))}) / 5), 6) AS twice_pinball FROM s GROUP BY task")
def weighted_interval_score(spark, sf_dir):
    rows = _quantiles(spark, sf_dir).withColumn("q", _ordered())
    return rows.groupBy("task").agg(r(F.avg(mx.weighted_interval_score(F.col("y"), F.col("q"), TAUS))).alias("wis"), r(2 * F.avg(mx.mean_pinball(F.col("y"), F.col("q"), TAUS))).alias("twice_pinball"))


@query("M12_reliability", f"{_Q_SQL} SELECT method, tau, round(avg(CAST(y <= q[k] AS DOUBLE)), 6) AS cdf, round(abs(avg(CAST(y <= q[k] AS DOUBLE)) - tau), 6) AS distance FROM s, (VALUES (1, 0.025::DOUBLE), (2, 0.1::DOUBLE), (3, 0.5::DOUBLE), (4, 0.9::DOUBLE), (5, 0.975::DOUBLE)) t(k, tau) GROUP BY method, tau")
def reliability(spark, sf_dir):
    found = mx.reliability(_quantiles(spark, sf_dir).withColumn("q", _ordered()), ["method"], "y", "q", TAUS)
    return found.select("method", "tau", r("cdf").alias("cdf"), r("distance").alias("distance"))


_DROPS = [f"greatest(q{k} - q{k + 1}, 0.0)" for k in range(4)]


@query("M13_crossing", f"{_Q_SQL}, d AS (SELECT method, greatest({', '.join(_DROPS)}) AS top, ({' + '.join(_DROPS)}) / 4 AS mean_drop FROM s) SELECT method, round(avg(CAST(top > 0 AS DOUBLE)), 6) AS crossing_rate, round(avg(mean_drop), 6) AS mean_decrease, round(coalesce(avg(top) FILTER (top > 0), 0), 6) AS mean_largest FROM d GROUP BY method")
def crossing(spark, sf_dir):
    found = mx.crossing(_quantiles(spark, sf_dir), ["method"], [F.col(f"q{k}") for k in range(5)])
    return found.select("method", *(r(c).alias(c) for c in ("crossing_rate", "mean_decrease", "mean_largest")))


@query(
    "J11_best_run",
    f"""WITH {FORECASTS_SQL}, c AS (SELECT task, method, seed, {_PICP} AS picp, {_PINAW} AS pinaw FROM forecasts GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY picp < 0.35, CASE WHEN picp >= 0.35 THEN pinaw ELSE -picp END, method, seed) AS k FROM c)
        SELECT task, method, seed FROM o WHERE k = 1""",
)
def best_run(spark, sf_dir):
    """Feasible runs first, narrower before wider; among infeasible ones, better covered first."""
    scores = mx.interval_scores(F.col("y"), F.col("lower"), F.col("upper"), 0.1)
    runs = forecasts(spark, sf_dir).groupBy("task", "method", "seed").agg(scores["picp"].alias("picp"), scores["pinaw"].alias("pinaw"))
    order = [F.col("picp") < 0.35, F.when(F.col("picp") >= 0.35, F.col("pinaw")).otherwise(-F.col("picp")), F.col("method"), F.col("seed")]
    return mx.arg_best(runs, ["task"], order, ["method", "seed"])


@query(
    "T30_conformalised_intervals",
    f"""WITH {FORECASTS_SQL}, c AS (SELECT *, seed <= 3 AS is_cal, greatest(lower - y, y - upper, 0.0) AS score FROM forecasts), n AS (SELECT task, score, row_number() OVER (PARTITION BY task ORDER BY score) AS k, count(*) OVER (PARTITION BY task) AS n FROM c WHERE is_cal),
        q AS (SELECT task, max(score) AS q_hat FROM n WHERE k = ceil((n - 1) * (1 - 0.1)) + 1 GROUP BY task), e AS (SELECT c.*, greatest(lower - q_hat, 0.0) AS lo, greatest(least(upper + q_hat, 105.0), greatest(lower - q_hat, 0.0)) AS hi FROM c JOIN q USING (task) WHERE NOT is_cal)
        SELECT task, round(avg(CAST(y BETWEEN lo AND hi AS DOUBLE)), 6) AS picp, round(avg(hi - lo), 6) AS mpiw FROM e GROUP BY task""",
)
def conformalised_intervals(spark, sf_dir):
    """Calibrate on some seeds, widen, clip and score the others: one plan."""
    rows = forecasts(spark, sf_dir).withColumn("score", fx.conformal_score(F.col("y"), F.col("lower"), F.col("upper")))
    q = st.rank_statistic(rows.where("seed <= 3"), ["task"], "score", 0.1, finite_sample=False).select("task", "q_hat")
    wide = rows.where("seed > 3").join(q, "task")
    lo, hi = fx.clip_bounds(*fx.expand(F.col("lower"), F.col("upper"), F.col("q_hat")), 0.0, 105.0)
    scored = wide.withColumns({"lo": lo, "hi": hi})
    return scored.groupBy("task").agg(r(mx.coverage(F.col("y"), F.col("lo"), F.col("hi"))).alias("picp"), r(F.avg(F.col("hi") - F.col("lo"))).alias("mpiw"))
