"""Held-out rows stay away until selections are locked; candidates and models are selected on validation rows."""

import json
import uuid

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe.operators import learning as ln
from galeframe.operators import selection
from galeframe.plans import catalog, studies
from galeframe.sources.storage import shared_dir

from .conftest import SMALL
from .test_catalogue import comparable, sql  # noqa: F401
from .whole_fits import pinball_fit


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def reader(spark, path):
    rows = spark.createDataFrame([(k, ["train", "validation", "calibration", "test"][k % 4]) for k in range(20)] + [(99, None)], "id int, split string")
    return selection.HeldOutReader(rows, spark.createDataFrame([("a",), ("b",)], "task string"), ["task"], path)


def test_held_out_rows_need_a_whole_and_unchanged_lock(spark, path):
    r = reader(spark, path)
    assert r.read("train").count() == r.read("validation").count() == 5 and r.readable().count() == 11
    for split in ("calibration", "test"):
        with pytest.raises(PermissionError):
            r.read(split)
    frame = lambda rows: spark.createDataFrame(rows, "task string, method string, score double")
    for rows in ([("a", "m", 1.0)], [("a", "m", 1.0), ("b", "m", 1.0), ("b", "n", 2.0)], [("a", "m", 1.0), ("b", "m", 1.0), ("c", "m", 1.0)]):
        with pytest.raises(ValueError, match="cannot be locked"):
            selection.write_lock(frame(rows), r.expected, ["task"], path)
    with pytest.raises(PermissionError):
        r.read("test")
    good = frame([("a", "m", 1.0), ("b", None, 2.0)])
    assert selection.write_lock(good, r.expected, ["task"], path).count() == 2
    assert r.read("test").count() == r.read("test", good).count() == 5
    assert selection.write_lock(good, r.expected, ["task"], path).count() == 2  # the same again is no fault
    with pytest.raises(ValueError, match="other selections"):
        selection.write_lock(frame([("a", "m", 1.0), ("b", "null", 2.0)]), r.expected, ["task"], path)
    with pytest.raises(PermissionError, match="other selections"):
        r.read("test", frame([("a", "m", 1.5), ("b", None, 2.0)]))
    changed = f"{path}-changed"
    spark.read.parquet(path).withColumn("method", F.lit("other")).write.parquet(changed)
    with pytest.raises(PermissionError, match="2 records changed"):
        reader(spark, changed).read("test")


def test_the_query_refuses_before_and_equals_its_sql_after(spark, sql):  # noqa: F811
    found, expected = catalog.QUERIES["T25_held_out_scores"](spark, SMALL).toPandas(), sql.execute(catalog.ORACLES["T25_held_out_scores"]).df()
    pd.testing.assert_frame_equal(comparable(found), comparable(expected), check_dtype=False, rtol=0, atol=1e-6)


def test_nine_quantiles_selected_from_stored_predictions(spark, path):
    rows = studies._studied(spark, SMALL)
    features = ln.nystroem_features(rows, "x", ln.landmarks(rows.where("split = 'train'"), "x", 4, seed=1, runs=1), 0.05)
    r = selection.HeldOutReader(features, spark.createDataFrame([("s",)], "study string"), ["study"], f"{path}/lock")
    found = {x["candidate"]: x for x in selection.tune_quantiles(r, "s", "vec_id", "z", "y", "is_target", studies.CANDIDATES, studies.NINE, path).collect()}
    local = path.removeprefix("file:")
    expected = duckdb.sql(f"""
        SELECT candidate, round(avg(greatest(tau * (y - prediction), (tau - 1) * (y - prediction))), 9) AS score, count(DISTINCT tau) AS quantiles, count(DISTINCT vec_id) AS n,
               (SELECT count(*) FROM (SELECT prediction < lag(prediction) OVER (PARTITION BY vec_id, candidate ORDER BY tau) AS crossed FROM '{local}/validation/*.parquet') WHERE crossed) AS crossings
        FROM '{local}/validation/*.parquet' GROUP BY candidate ORDER BY score, candidate""").df()
    assert all(found[c].score == pytest.approx(s, abs=2e-9) for c, s in zip(expected.candidate, expected.score, strict=True)) and len(found) == 3
    assert set(expected.quantiles) == {9} and set(expected.crossings) == {0} and set(expected.n) == {rows.where("split = 'validation'").count()}
    assert all(x.certified for x in found.values())
    best = expected.candidate[0]
    assert [c for c, x in found.items() if x.selected] == [best] and found[best].test_score > 0
    assert all(x.test_score is None for c, x in found.items() if c != best)
    # one of the fits against the same problem in NumPy
    train = features.where("split = 'train'").select("z", "y").collect()
    z, y = np.array([t["z"] for t in train]), np.array([t["y"] for t in train])
    whole = pinball_fit(z, y, np.full(len(y), 1 / len(y)), 0.3, 0.1, relative=1e-5)
    fit = selection.fit_candidates(features.where("split = 'train'"), "z", "y", "is_target", [("plain", 0.1, 0.0, 0.0)], [0.3]).first()
    assert fit["dual"] <= whole.primal + 1e-9 and whole.dual <= fit["primal"] + 1e-9 and fit["primal"] == pytest.approx(whole.primal, rel=5e-4)


def test_random_trials_differ():
    trials = selection.random_trials({"a": {"p": [1, 2]}, "b": {"q": [3]}}, 10, seed=1)
    assert [t[0] for t in trials] == [0, 1, 2] and len({(n, json.dumps(p)) for _, n, p in trials}) == 3


def test_search_in_waves(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 3))
    y = x @ [1.0, 2.0, -1.0] + 0.01 * r.standard_normal(400)
    rows = spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    trials = [(0, "ridge", {"penalty": 1e-3}), (1, "ridge", {"penalty": 1e4}), (2, "pinball", {"penalty": 1e-6, "steps": 1}), (3, "forest", {"trees": 2, "depth": 1}), (4, "ridge", {"penalty": 1e5})]
    told, winner = selection.search_models(rows.where("id < 300"), rows.where("id >= 300"), "id", "x", "y", trials, [0, 1])
    told = told.collect()
    assert [sum(t.wave == w for t in told) for w in range(3)] == [5, 2, 1]
    assert not next(t for t in told if t.model == "pinball").certified and not any(t.kept for t in told if t.model == "pinball")
    last = [t for t in told if t.wave == 2]
    assert [(t.trial, t.kept) for t in last] == [(0, True)]
    assert winner(rows).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.1
    with pytest.raises(ValueError, match="certified"):
        selection.search_models(rows.limit(50), rows.limit(50), "id", "x", "y", trials[2:3], [0])


def test_resumed_fits_end_where_one_long_run_does(spark):
    r = np.random.default_rng(7)
    z = r.standard_normal((500, 4))
    y = z @ [1.0, 0.0, -1.0, 2.0] + r.standard_normal(500)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(z, y, strict=True)], "z array<double>, y double").coalesce(1)
    jobs = spark.createDataFrame([("a", 0.2, 0), ("b", 0.8, 1)], "job string, tau double, seed int")
    whole = {f.job: f for f in ln.fit_jobs(rows, jobs, "z", "y", 0.01).collect()}
    state = ln.fit_jobs(rows, jobs, "z", "y", 0.01, most=2)
    assert all(f.iterations == 2 and not f.converged for f in state.collect())
    for most in (4, 200):
        state = ln.fit_jobs(rows, jobs, "z", "y", 0.01, most=most, resume=state)
    for f in state.collect():
        assert f.converged and f.iterations == whole[f.job].iterations > 4
        assert f.primal == pytest.approx(whole[f.job].primal, rel=1e-9) and f.dual == pytest.approx(whole[f.job].dual, rel=1e-9) and np.allclose(f.weights, whole[f.job].weights)
    again = ln.fit_jobs(rows, jobs, "z", "y", 0.01, resume=state)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, state.collect()))  # closed certificates stay as they are
    with pytest.raises(ValueError, match="another fit"):
        ln.fit_jobs(rows, spark.createDataFrame([("a", 0.3, 0)], jobs.schema), "z", "y", 0.01, resume=state.withColumn("converged", F.lit(False)).withColumn("dual", F.lit(-1e9)))


def test_extended_fits_keep_the_first_records(spark):
    found = catalog.QUERIES["T26_extended_fits"](spark, SMALL).collect()
    first, again = ([r for r in found if r.attempt == k] for k in (0, 1))
    assert len(first) == 3 and {r.job for r in again} == {r.job for r in first if not r.converged}
    assert all(r.iterations <= 3 for r in first) and all(r.converged and r.iterations > 3 for r in again)
