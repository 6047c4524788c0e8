"""Fits and predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from galeframe.functions import scalar as fx
from galeframe.operators import exact_dual, histogram_trees
from galeframe.operators import learning as ln
from galeframe.operators import regressors as rg
from galeframe.operators import stats as st
from galeframe.operators import studies
from galeframe.plans.registry import query, r
from galeframe.sources.schema import FORECASTS_SQL, forecasts, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"), (F.col("label") >= 5).alias("is_target"))


_MOMENTS_SQL = """WITH e AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE label < 5)"""


@query("G31_moments", f"{_MOMENTS_SQL} SELECT CAST(pos AS INTEGER) AS pos, round(var_pop(CAST(x AS DOUBLE)), 6) AS variance, round(covar_pop(CAST(x AS DOUBLE), y), 6) + 0.0 AS cross_covariance FROM e GROUP BY pos")
def moments(spark, sf_dir):
    found = ln.moments(_vectors(spark, sf_dir), "x", "y", "is_target")
    rows = list(zip(range(len(found.mean[0])), np.diag(found.covariance()).tolist(), found.cross_covariance().tolist(), strict=True))
    return spark.createDataFrame(rows, "pos int, variance double, cross_covariance double").select("pos", r("variance").alias("variance"), r("cross_covariance").alias("cross_covariance"))


@query(
    "T2_population_scaling",
    "WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), s AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS sd FROM e GROUP BY pos) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((CAST(x AS DOUBLE) - m) / sd, 5) + 0.0 AS z FROM e JOIN s USING (pos)",
)
def population_scaling(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    stats = rows.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return rows.join(F.broadcast(stats), "pos").select("vec_id", "pos", r((F.col("x") - F.col("m")) / F.col("sd"), 5).alias("z"))


@query("T1_landmarks")
def landmarks(spark, sf_dir):
    """Centres with half of the weight on each domain, the cheapest of ten starts."""
    rows = _vectors(spark, sf_dir)
    sizes = rows.groupBy("is_target").agg((F.lit(0.5) / F.count(F.lit(1))).alias("weight"))
    centres = ln.landmarks(rows.join(F.broadcast(sizes), "is_target"), "x", 8, seed=1, weight="weight", runs=10)
    return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "landmark int, centre array<double>")


@query("T3_nystroem")
def nystroem(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return ln.nystroem_features(rows.select("vec_id", "x"), "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05).select("vec_id", "z")


@query("T4_pinball_fits")
def pinball_fits(spark, sf_dir):
    """Certified fits of several quantiles and seeds, one row a job."""
    rows = _vectors(spark, sf_dir)
    jobs = spark.createDataFrame([(f"tau{t}_seed{s}", t, s) for t in (0.1, 0.5, 0.9) for s in (0, 1)], "job string, tau double, seed int")
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05)
    return ln.fit_jobs(features, jobs, "z", "y", penalty=0.1).select("job", "tau", "n", "primal", "dual", "iterations", "converged")


def _domain_fits(spark, sf_dir, jobs):
    """Fits of the domain-adapted objective for (job, tau, variance, discrepancy): source and target rows weigh as much as one another in sum."""
    rows = _vectors(spark, sf_dir)
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05)
    found = ln.moments(features, "z", "y", "is_target")
    cost = F.when(F.col("is_target"), 50.0 / max(found.n[1], 1)).otherwise(50.0 / max(found.n[0], 1))
    terms = {job: ln.domain_terms(found, variance, discrepancy) for job, _, variance, discrepancy in jobs}
    table_of_jobs = spark.createDataFrame([(job, tau, 0) for job, tau, _, _ in jobs], "job string, tau double, seed int")
    return ln.fit_jobs(features.withColumn("cost", cost), table_of_jobs, "z", "y", cost="cost", terms=terms)


@query("T4_domain_fits")
def domain_fits(spark, sf_dir):
    """Certified fits with centred residual variance and discrepancy, one row a quantile."""
    return _domain_fits(spark, sf_dir, [(f"tau{t}", t, 2.0, 20.0) for t in (0.1, 0.5, 0.9)]).select("job", "tau", "n", "primal", "dual", "iterations", "converged")


@query("T27_fitted_variants")
def fitted_variants(spark, sf_dir):
    """The full objective and those without one or both of its terms, fitted; nothing else differs."""
    found = _domain_fits(spark, sf_dir, [(name, 0.5, v, d) for name, v, d in studies.variants(2.0, 20.0)])
    return found.select(F.col("job").alias("variant"), "primal", "dual", "converged", "intercept", "weights")


@query("T11_batch_prediction")
def batch_prediction(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    w, b = ln.ridge(ln.moments(rows, "x", "y", "is_target"), 1.0)
    return ln.predict_linear(rows, "x", w, b).select("vec_id", r("prediction", 5).alias("prediction"))


@query("T13_forest")
def forest(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return ln.predict_ml(rows, ln.forest(rows, "x", "y", trees=8, depth=4), "x").select("vec_id", "prediction")


@query("T13_boosted")
def boosted(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return ln.predict_ml(rows, ln.boosted(rows, "x", "y", rounds=4), "x").select("vec_id", "prediction")


@query("T14_forest_interval")
def forest_interval(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return ln.forest_interval(rows, ln.forest(rows, "x", "y", trees=8, depth=4), "x").select("vec_id", "lower", "upper")


@query("T15_cluster_boosted")
def cluster_boosted(spark, sf_dir):
    return ln.cluster_boosted(_vectors(spark, sf_dir), "x", "y", k=2).select("vec_id", "cluster", "prediction")


@query("T16_ridge_weights")
def ridge_weights(spark, sf_dir):
    w, _ = ln.ridge(ln.moments(_vectors(spark, sf_dir), "x", "y", "is_target"), 1.0)
    return spark.createDataFrame(list(enumerate(w.tolist())), "pos int, weight double").select("pos", r("weight").alias("weight"))


@query("T19_residual_intervals")
def residual_intervals(spark, sf_dir):
    rows = forecasts(spark, sf_dir).select("window_index", "seed", "prediction", (F.col("y") - F.col("prediction")).alias("residual"))
    return ln.residual_intervals(rows, "prediction", "residual").select("window_index", "seed", "bin", r("lower").alias("lower"), r("upper").alias("upper"))


@query("T16_kernel_ridge")
def kernel_ridge(spark, sf_dir):
    """Ridge on Nystroem features: kernel ridge with a bounded number of landmarks."""
    rows = _vectors(spark, sf_dir)
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05)
    w, b = ln.ridge(ln.moments(features, "z", "y", "is_target"), 0.1)
    return ln.predict_linear(features, "z", w, b).select("vec_id", r("prediction", 5).alias("prediction"))


@query("T18_kernel_quantiles")
def kernel_quantiles(spark, sf_dir):
    """Lower and upper quantile by certified pinball fits, endpoints in order."""
    rows = _vectors(spark, sf_dir)
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05)
    jobs = spark.createDataFrame([("low", 0.05, 0), ("high", 0.95, 0)], "job string, tau double, seed int")
    fits = {f["job"]: f for f in ln.fit_jobs(features, jobs, "z", "y", penalty=0.1).collect()}
    out = features
    for name in ("low", "high"):
        out = ln.predict_linear(out, "z", np.array(fits[name]["weights"]), fits[name]["intercept"], name)
    return out.select("vec_id", F.least("low", "high").alias("lower"), F.greatest("low", "high").alias("upper"))


@query("T6_exact_dual")
def exact_dual_fits(spark, sf_dir):
    """Fits on the whole kernel, each domain with half of the cost; one row a quantile."""
    rows = _vectors(spark, sf_dir)
    sizes = rows.groupBy("is_target").agg((F.lit(0.5) / F.count(F.lit(1))).alias("cost"))
    fits, state = exact_dual.fit_exact(rows.join(F.broadcast(sizes), "is_target"), [0.1, 0.5, 0.9], "vec_id", "x", "y", gamma=0.05, penalty=0.1, cost="cost")
    n, *support = state.agg(F.count_if(F.col("cost") > 0), *(F.count_if(F.col("beta")[k] != 0) for k in range(3))).first()
    told = [(f.tau, n, s, f.primal, f.dual, f.steps, f.converged) for f, s in zip(fits, support, strict=True)]
    return spark.createDataFrame(told, "tau double, n long, support long, primal double, dual double, steps int, converged boolean")


@query("T18_exact_kernel_quantiles")
def exact_kernel_quantiles(spark, sf_dir):
    """Lower and upper quantile of every row by fits on the whole kernel, endpoints in order."""
    fits, state = exact_dual.fit_exact(_vectors(spark, sf_dir), [0.05, 0.95], "vec_id", "x", "y", gamma=0.05, penalty=0.1)
    rows = exact_dual.predictions(state, fits, ["low", "high"])
    return rows.select(F.col("key").alias("vec_id"), F.least("low", "high").alias("lower"), F.greatest("low", "high").alias("upper"))


@query("T21_stacking")
def stacking(spark, sf_dir):
    """A ridge over the predictions of a forest, boosted trees and a ridge, fitted on rows that those did not see."""
    rows = _vectors(spark, sf_dir)
    part = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(2)) == 0
    base = rows.where(part)
    w, b = ln.ridge(ln.moments(base, "x", "y", "is_target"), 1.0)
    out = ln.predict_linear(rows, "x", w, b, "p0")
    out = ln.predict_ml(out, ln.forest(base, "x", "y", trees=8, depth=4), "x", "p1")
    out = ln.predict_ml(out, ln.boosted(base, "x", "y", rounds=4), "x", "p2").withColumn("p", F.array("p0", "p1", "p2"))
    v, c = ln.ridge(ln.moments(out.where(~part), "p", "y", "is_target"), 1.0)
    return ln.predict_linear(out, "p", v, c).select("vec_id", r("prediction", 5).alias("prediction"))


@query("T5_adam")
def adam(spark, sf_dir):
    """The domain-adapted objective by mini-batch Adam, to stand beside its certified fits."""
    rows = _vectors(spark, sf_dir)
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05)
    found = ln.moments(features, "z", "y", "is_target")
    cost = F.when(F.col("is_target"), 50.0 / max(found.n[1], 1)).otherwise(50.0 / max(found.n[0], 1))
    taus = [0.1, 0.5, 0.9]
    at = rg.adam_fit(features.withColumn("cost", cost), "z", "y", "cost", taus, ln.domain_terms(found, 2.0, 20.0), batches=4, epochs=10, rate=0.1, key="vec_id")
    return spark.createDataFrame([(t, float(p[-1]), p[:-1].tolist()) for t, p in zip(taus, at, strict=True)], "tau double, intercept double, weights array<double>")


@query("T13_boosted_quantiles")
def boosted_quantiles(spark, sf_dir):
    """A lower and an upper quantile by trees grown on the pinball loss, endpoints in order."""
    rows = _vectors(spark, sf_dir)
    out = rows
    for name, tau in (("low", 0.05), ("high", 0.95)):
        out = rg.boosted_quantile(rows, "x", "y", tau, rounds=3).predict(out, "x", name)
    return out.select("vec_id", F.least("low", "high").alias("lower"), F.greatest("low", "high").alias("upper"))


@query("T13_histogram_boosting")
def histogram_boosting(spark, sf_dir):
    """The mean and two quantiles by boosting over binned features, endpoints in order."""
    out = rows = _vectors(spark, sf_dir).select("vec_id", "x", "y")
    for name, tau in (("prediction", None), ("low", 0.05), ("high", 0.95)):
        out = histogram_trees.boost(rows, "x", "y", rounds=5, depth=3, rate=0.3, tau=tau).predict(out, "x", name)
    return out.select("vec_id", r("prediction").alias("prediction"), r(F.least("low", "high")).alias("lower"), r(F.greatest("low", "high")).alias("upper"))


@query("T16_random_nodes")
def random_nodes(spark, sf_dir):
    """Ridge on random hidden nodes."""
    rows = _vectors(spark, sf_dir)
    return rg.fitted("elm", rows, "x", "y")(rows).select("vec_id", r("prediction", 5).alias("prediction"))


@query("T16_bounded_ridge")
def bounded_ridge(spark, sf_dir):
    """Ridge on Nystroem features, reweighted so that no row's influence is unbounded."""
    rows = _vectors(spark, sf_dir)
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05)
    return rg.fitted("bounded", features, "z", "y", penalty=0.1)(features).select("vec_id", r("prediction", 5).alias("prediction"))


@query("T16_broad_forest")
def broad_forest(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rg.fitted("broad_forest", rows, "x", "y")(rows).select("vec_id", "prediction")


@query("T19_density_intervals")
def density_intervals(spark, sf_dir):
    rows = forecasts(spark, sf_dir).select("window_index", "seed", "prediction", (F.col("y") - F.col("prediction")).alias("residual"))
    return rg.density_intervals(rows, ["window_index", "seed"], "prediction", "residual", draws=5).select("window_index", "seed", "bin", r("lower").alias("lower"), r("upper").alias("upper"))


@query(
    "T20_zero_width_intervals",
    f"""WITH {FORECASTS_SQL}, c AS (SELECT *, abs(y - prediction) AS plain, abs(y - prediction) / 1e-6 AS scaled FROM forecasts WHERE seed <= 3),
        n AS (SELECT task, plain, scaled, row_number() OVER (PARTITION BY task ORDER BY plain) AS k, count(*) OVER (PARTITION BY task) AS n FROM c),
        q AS (SELECT task, max(plain) AS q_plain, max(scaled) AS q_scaled FROM n WHERE k = ceil((n + 1) * (1 - 0.1)) GROUP BY task)
        SELECT task, window_index, seed, round(prediction - q_plain, 6) + 0.0 AS lower, round(prediction + q_plain, 6) + 0.0 AS upper, round(q_scaled * 1e-6, 4) + 0.0 AS scaled_half FROM forecasts JOIN q USING (task) WHERE seed > 3""",
)
def zero_width_intervals(spark, sf_dir):
    """Point forecasts as intervals of no width, conformalised: the width is the quantile alone, and a score scaled by the width is one over the least width."""
    rows = forecasts(spark, sf_dir).withColumns({"low": F.col("prediction"), "high": F.col("prediction")})
    scored = rows.where("seed <= 3").withColumns({"plain": fx.conformal_score(F.col("y"), F.col("low"), F.col("high")), "scaled": fx.conformal_score(F.col("y"), F.col("low"), F.col("high"), scaled=True)})
    q = [st.rank_statistic(scored, ["task"], c, 0.1).select("task", F.col("q_hat").alias(f"q_{c}")) for c in ("plain", "scaled")]
    wide = rows.where("seed > 3").join(q[0].join(q[1], "task"), "task")
    low, high = fx.expand(F.col("low"), F.col("high"), F.col("q_plain"))
    return wide.select("task", "window_index", "seed", r(low).alias("lower"), r(high).alias("upper"), r(F.col("q_scaled") * 1e-6, 4).alias("scaled_half"))


@query(
    "T21_nearest_mean",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos, label FROM embeddings), d AS (SELECT q.vec_id, t.vec_id AS other, max(t.label) AS y, sum((CAST(q.x AS DOUBLE) - t.x) * (CAST(q.x AS DOUBLE) - t.x)) AS far FROM e q JOIN e t USING (pos) WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, t.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY far, other) AS place FROM d) SELECT vec_id, round(avg(y), 6) AS prediction FROM k WHERE place <= 5 GROUP BY vec_id""",
)
def nearest_mean(spark, sf_dir):
    """The rows whose id is divisible by 100 against all rows; the five nearest, the row itself among them."""
    rows = _vectors(spark, sf_dir)
    return rg.nearest_mean(rows.where("vec_id % 100 = 0"), rows, "vec_id", "x", "y", 5).select("vec_id", r("prediction").alias("prediction"))


@query("T35_model_factory")
def model_factory(spark, sf_dir):
    """Every model of the factory fitted on half of the rows and scored on the other."""
    rows = _vectors(spark, sf_dir)
    part = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(2)) == 0
    names = ("ridge", "elm", "bounded", "forest", "broad_forest", "boosted", "quantile_boosted")
    return rg.factory_scores(spark, rows.where(part), rows.where(~part), "x", "y", [(n, {}) for n in names])
