"""Designs, selections, locks and certificate policies as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from galeframe.operators import learning as ln
from galeframe.operators import selection, studies
from galeframe.plans.learning import _vectors
from galeframe.plans.registry import query, r
from galeframe.sources import storage as so
from galeframe.sources.schema import FORECASTS_SQL, forecasts

POINTS = 18
#: Ranges as powers of ten of the kernel width and the loss, and the target's share.
RANGES = {"log_gamma": (-4.0, -1.0), "log_loss": (2.0, 6.0), "target_fraction": (0.05, 0.995)}
STEPS = {"log_gamma": [-0.5, 0.0, 0.5], "log_loss": [-0.5, 0.0, 0.5], "target_fraction": [-0.1, 0.0, 0.1]}

_DESIGN = "design AS (SELECT point, " + ", ".join(
    f"{low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * (row_number() OVER (ORDER BY md5('11|{name}|' || point)) - 0.5) / {POINTS} AS {name}" for name, (low, high) in RANGES.items()
) + f" FROM range({POINTS}) t(point))"


def _design(spark):
    return studies.latin_hypercube(spark, POINTS, RANGES, 11)


@query("I8_latin_hypercube", f"WITH {_DESIGN} SELECT point, " + ", ".join(f"round({c}, 6) AS {c}" for c in RANGES) + " FROM design")
def latin_hypercube(spark, sf_dir):
    return _design(spark).select("point", *(r(c).alias(c) for c in RANGES))


def _moved(name):
    low, high = RANGES[name]
    return f"round(greatest({low}, least({high}, {name} + {name[:5]}_step)), 6) AS {name}"


@query(
    "T31_refinement",
    f"""WITH {_DESIGN}, around AS (SELECT DISTINCT {", ".join(map(_moved, RANGES))} FROM design, {", ".join(f"(VALUES {', '.join(f'({s}::DOUBLE)' for s in steps)}) s{k}({name[:5]}_step)" for k, (name, steps) in enumerate(STEPS.items()))} WHERE point < 2),
        tried AS (SELECT {", ".join(f"round({c}, 6) AS {c}" for c in RANGES)} FROM design) SELECT * FROM around EXCEPT SELECT * FROM tried""",
)
def refinement(spark, sf_dir):
    """The second stage of a search: neighbours of two selected points that were not tried before."""
    design = _design(spark)
    return studies.refined(design.where("point < 2"), design, STEPS, RANGES).select(*RANGES)


def _results(spark, sf_dir):
    """One row a (task, method, seed) with its error; fits of an error of 60 or more stand for uncertified ones."""
    rows = forecasts(spark, sf_dir).groupBy("task", "method", "seed").agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("rmse"))
    return rows.withColumn("certified", F.col("rmse") < 60)


_SELECTED = """results AS (SELECT task, method, seed, sqrt(avg((y - prediction) * (y - prediction))) AS rmse FROM forecasts GROUP BY ALL),
    per AS (SELECT task, method, round(avg(rmse), 9) AS score, bool_and(rmse < 60) AS fine, count(DISTINCT seed) AS seeds FROM results GROUP BY ALL),
    chosen AS (SELECT task, method, score FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score, method) AS k FROM per JOIN (SELECT task, count(DISTINCT seed) AS wanted FROM results GROUP BY task) USING (task) WHERE fine AND seeds = wanted) WHERE k = 1)"""


def _selected(spark, sf_dir):
    return studies.select_certified(_results(spark, sf_dir), ["task"], "method", "seed", "rmse", "certified")


@query("T24_certified_selection", f"WITH {FORECASTS_SQL}, {_SELECTED} SELECT task, method, round(score, 6) AS score FROM chosen")
def certified_selection(spark, sf_dir):
    return _selected(spark, sf_dir).select("task", "method", r("score").alias("score"))


@query(
    "T25_lock",
    f"WITH {FORECASTS_SQL}, {_SELECTED} SELECT task, method, sha256(CAST(task AS VARCHAR) || '|' || method) AS record_sha256, (SELECT count(*) FROM chosen) = (SELECT count(DISTINCT task) FROM forecasts) AS complete FROM chosen",
)
def selection_lock(spark, sf_dir):
    tasks = forecasts(spark, sf_dir).select("task").distinct().count()
    return studies.lock(_selected(spark, sf_dir).select("task", "method"), ["task"], tasks)


@query(
    "T32_verification",
    f"""WITH {FORECASTS_SQL}, {_SELECTED}, now AS (SELECT task, CASE WHEN k = 2 THEN 'other' ELSE method END AS method FROM (SELECT *, row_number() OVER (ORDER BY task) AS k FROM chosen) WHERE k <> 1)
        SELECT task, CASE WHEN now.method IS NULL THEN 'missing' WHEN now.method = chosen.method THEN 'ok' ELSE 'changed' END AS status FROM chosen LEFT JOIN now USING (task)""",
)
def verification(spark, sf_dir):
    """A record that is gone and one that was changed are told from those that stayed."""
    chosen = _selected(spark, sf_dir).select("task", "method")
    first = [x["task"] for x in chosen.orderBy("task").limit(2).collect()]
    now = chosen.where(F.col("task") != first[0]).withColumn("method", F.when(F.col("task") == first[-1], "other").otherwise(F.col("method")))
    return studies.verified(studies.lock(chosen, ["task"], 0), studies.lock(now, ["task"], 0), ["task"])


@query("T28_seeds", f"WITH {FORECASTS_SQL} SELECT DISTINCT task, method, seed, substr(sha256('7|' || task || '|' || method || '|' || seed), 1, 16) AS seed_hex FROM forecasts")
def seeds(spark, sf_dir):
    """A stable seed for every job, from its own columns."""
    jobs = forecasts(spark, sf_dir).select("task", "method", "seed").distinct()
    return jobs.withColumn("seed_hex", F.substring(F.sha2(F.concat_ws("|", F.lit("7"), "task", "method", F.col("seed").cast("string")), 256), 1, 16))


_SENSITIVITY = [("default", 8, 500, 0.5), ("landmarks_4", 4, 500, 0.5), ("landmarks_8", 8, 500, 0.5), ("budget_250", 8, 250, 0.5), ("budget_500", 8, 500, 0.5), ("weight_0.3", 8, 500, 0.3), ("weight_0.5", 8, 500, 0.5)]


@query(
    "T34_sensitivity_jobs",
    f"WITH jobs AS (SELECT * FROM (VALUES {', '.join(f'({k}, {name!r}, {a}, {b}, {c}::DOUBLE)' for k, (name, a, b, c) in enumerate(_SENSITIVITY))}) t(job, branch, landmarks, budget, share)) SELECT job, branch, min(job) OVER (PARTITION BY landmarks, budget, share) AS same_as FROM jobs",
)
def sensitivity_jobs(spark, sf_dir):
    """One component changes a branch; branches of equal settings are fitted once."""
    jobs = spark.createDataFrame([(k, *row) for k, row in enumerate(_SENSITIVITY)], "job int, branch string, landmarks int, budget int, share double")
    return studies.aliased(jobs, ["landmarks", "budget", "share"], "job").select("job", "branch", "same_as")


@query("T26_extended_fits")
def extended_fits(spark, sf_dir):
    """Fits whose certificate is open after few steps go on from their stored state, at the same tolerance; the first records stay as they were."""
    rows = _vectors(spark, sf_dir)
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows, "x", 8, seed=1, runs=1), 0.05)
    jobs = spark.createDataFrame([(f"tau{t}", t, 0) for t in (0.1, 0.5, 0.9)], "job string, tau double, seed int")
    archive = so.shared_dir(spark) + f"/certificates-{uuid.uuid4().hex}"
    columns = ["attempt", "job", "primal", "dual", "iterations", "converged"]
    ln.fit_jobs(features, jobs, "z", "y", penalty=0.1, most=3).withColumn("attempt", F.lit(0)).write.parquet(archive)
    open_ones = spark.read.parquet(archive).where("NOT converged").drop("attempt")
    again = ln.fit_jobs(features, open_ones.select("job", "tau", "seed"), "z", "y", penalty=0.1, resume=open_ones)
    return spark.read.parquet(archive).select(columns).unionByName(again.withColumn("attempt", F.lit(1)).select(columns))


_SPLIT_SQL = "CASE WHEN seed <= 3 THEN 'validation' WHEN seed <= 5 THEN 'calibration' ELSE 'test' END"


@query(
    "T25_held_out_scores",
    f"""WITH {FORECASTS_SQL}, v AS (SELECT task, method, round(sqrt(avg((y - prediction) * (y - prediction))), 9) AS score FROM forecasts WHERE seed <= 3 GROUP BY task, method),
        chosen AS (SELECT task, method FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score, method) AS k FROM v) WHERE k = 1)
        SELECT task, method, true AS refused_before, count(*) AS n, round(sqrt(avg((y - prediction) * (y - prediction))), 6) AS rmse FROM forecasts JOIN chosen USING (task, method) WHERE seed > 5 GROUP BY task, method""",
)
def held_out_scores(spark, sf_dir):
    """The reader refuses test rows until every task's selection is locked; then the selected methods are scored on them."""
    rows = forecasts(spark, sf_dir).withColumn("split", F.expr(_SPLIT_SQL))
    path = f"{so.shared_dir(spark)}/lock-{uuid.uuid4().hex}"
    reader = selection.HeldOutReader(rows, rows.select("task").distinct(), ["task"], path)
    try:
        reader.read("test")
        refused = False
    except PermissionError:
        refused = True
    error = lambda: F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))
    scores = reader.read("validation").groupBy("task", "method").agg(F.round(error(), 9).alias("score"))
    chosen = selection.metrics.arg_best(scores, ["task"], [F.col("score"), F.col("method")], ["method", "score"]).select("task", "method", "score")
    locked = selection.write_lock(chosen, reader.expected, ["task"], path)
    tested = reader.read("test", chosen).join(locked.select("task", "method"), ["task", "method"])
    return tested.groupBy("task", "method").agg(F.lit(refused).alias("refused_before"), F.count(F.lit(1)).alias("n"), F.round(error(), 6).alias("rmse"))


NINE = [k / 10 for k in range(1, 10)]
#: Settings of a quantile model: name, penalty, weights of the source's variance and of the distance of the domains' means.
CANDIDATES = [("plain", 0.1, 0.0, 0.0), ("strict", 10.0, 0.0, 0.0), ("adapted", 0.1, 0.05, 0.5)]


def _studied(spark, sf_dir):
    """Vectors with their split by a hash: half train, a quarter each validation and test."""
    part = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(4))
    return _vectors(spark, sf_dir).withColumn("split", F.when(part < 2, "train").when(part == 2, "validation").otherwise("test"))


@query("T33_nine_quantiles")
def nine_quantiles(spark, sf_dir):
    """Nine quantiles of three settings fitted together, selected by mean pinball on the validation quarter, locked, then tested."""
    rows = _studied(spark, sf_dir)
    centres = ln.landmarks(rows.where("split = 'train'"), "x", 8, seed=1, runs=1)
    features = ln.nystroem_features(rows, "x", centres, 0.05)
    expected = spark.createDataFrame([("nine_quantiles",)], "study string")
    folder = f"{so.shared_dir(spark)}/quantiles-{uuid.uuid4().hex}"
    reader = selection.HeldOutReader(features, expected, ["study"], f"{folder}/lock")
    return selection.tune_quantiles(reader, "nine_quantiles", "vec_id", "z", "y", "is_target", CANDIDATES, NINE, folder)


SPACE = {"ridge": {"penalty": [0.1, 1.0, 10.0]}, "elm": {"hidden": [16, 32], "penalty": [1.0, 10.0]}, "forest": {"depth": [3, 4], "trees": [4, 8]}, "pinball": {"penalty": [0.01, 0.1], "steps": [1, 60]}}


@query("T24_model_search")
def model_search(spark, sf_dir):
    """Random trials over several models in waves on growing shares of the training rows; fits without a certificate are out."""
    rows = _studied(spark, sf_dir)
    told, _ = selection.search_models(rows.where("split = 'train'"), rows.where("split = 'validation'"), "vec_id", "x", "y", selection.random_trials(SPACE, 6, seed=3), [0, 1])
    return told
