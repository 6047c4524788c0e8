import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.operators import quantiles, regressors


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] + r.normal(size=400) * (1 + (x[:, 2] > 0))
    return spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(400)], "row_id long, x array<double>, y double").repartition(5).cache()


def arrays(rows):
    found = rows.orderBy("row_id").collect()
    return np.array([r.x for r in found]), np.array([r.y for r in found])


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    r = np.random.default_rng(accuracy)
    # one group holds nearly all rows, one has none with a value, one has no key
    data = [(0, float(v)) for v in np.round(r.normal(size=3000), 2)] + [(1, 4.0), (1, None), (2, None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(data, "k int, v double").repartition(4)
    wanted = {"low": ("v", 0.0), "a": ("v", 0.02), "b": ("v", 0.5), "c": ("v", 0.98), "high": ("v", 1.0)}
    found = {x.k: x for x in quantiles.exact_percentiles(df, ["k"], wanted).collect()}
    expected = df.groupBy("k").agg(*(F.percentile("v", p).alias(n) for n, (_, p) in wanted.items())).collect()
    assert len(found) == len(expected) == 4
    for x in expected:
        assert [found[x.k][n] for n in wanted] == pytest.approx([x[n] for n in wanted], abs=1e-12) if x.b is not None else found[x.k].b is None
    assert quantiles.exact_percentiles(df.limit(0), [], wanted).first().b is None


def test_adam_equals_its_steps(spark, rows):
    x, y = arrays(rows)
    terms = np.eye(3) * 2 + 0.1, np.array([0.1, 0.2, 0.3])
    dealt = rows.select("row_id", F.pmod(F.xxhash64("row_id", F.lit(0)), F.lit(3)).alias("b")).orderBy("row_id").collect()
    batch = np.array([r.b for r in dealt])
    found = regressors.adam_fit(rows.withColumn("cost", F.lit(0.5)), "x", "y", "cost", [0.2, 0.8], terms, batches=3, epochs=2, rate=0.05)
    for tau, got in zip((0.2, 0.8), found, strict=True):
        w, b, m, v, t = np.zeros(3), 0.0, np.zeros(4), np.zeros(4), 0
        for _ in range(2):
            for k in range(3):
                z, target = x[batch == k], y[batch == k]
                slope = np.where(target - z @ w - b >= 0, -tau, 1 - tau) * 0.5
                g = np.append(z.T @ slope + len(z) / 400 * (terms[0] @ w - terms[1]), slope.sum())
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                w, b = w - step[:3], b - step[3]
        assert np.allclose(got, np.append(w, b), atol=1e-9)


def test_bounded_ridge_ignores_wild_rows(spark, rows):
    wild = rows.withColumn("y", F.when(F.col("row_id") % 10 == 0, 500.0).otherwise(F.col("y")))
    w, b = regressors.bounded_ridge(wild, "x", "y", 0.1, rounds=15)
    assert np.allclose(w, [2, -1, 0], atol=0.35) and abs(b) < 0.35


def test_boosted_quantiles_cover_and_learn(spark, rows):
    for tau in (0.1, 0.9):
        model = regressors.boosted_quantile(rows, "x", "y", tau, rounds=4)
        out = model.predict(rows, "x").select("y", "prediction").collect()
        share = np.mean([r.y <= r.prediction for r in out])
        loss = lambda q: np.mean([max(tau * (r.y - q(r)), (tau - 1) * (r.y - q(r))) for r in out])  # noqa: B023, E731
        assert abs(share - tau) < 0.06
        assert loss(lambda r: r.prediction) < 0.8 * loss(lambda r: model.start)  # noqa: B023


@pytest.mark.parametrize("block", [4096, 40])
def test_nearest_rows_equal_a_scan(spark, rows, monkeypatch, block):
    monkeypatch.setattr(regressors, "QUERY_BLOCK", block)
    x, y = arrays(rows)
    asked = rows.where("row_id % 10 = 0")
    found = {r.row_id: r.prediction for r in regressors.nearest_mean(asked, rows, "row_id", "x", "y", 4).collect()}
    far = ((x[::10, None] - x[None]) ** 2).sum(-1)
    expected = {10 * k: y[np.lexsort((np.arange(400), far[k]))[:4]].mean() for k in range(40)}
    assert found == pytest.approx(expected)


def test_density_intervals_cover(spark, rows):
    wide = rows.select("row_id", F.col("x")[0].alias("prediction"), (F.col("y") - F.col("x")[0]).alias("residual"))
    out = regressors.density_intervals(wide, ["row_id"], "prediction", "residual", bins=4, bandwidth=0.2).collect()
    assert len(out) == 400 and {r.bin for r in out} == {0, 1, 2, 3}
    assert 0.86 < np.mean([r.lower <= r.prediction + r.residual <= r.upper for r in out]) < 0.96


def test_every_model_of_the_factory_learns(spark, rows):
    names = ["ridge", "elm", "bounded", "forest", "broad_forest", "boosted", "quantile_boosted"]
    found = {r.model: r.rmse for r in regressors.factory_scores(spark, rows.where("row_id < 300"), rows.where("row_id >= 300"), "x", "y", [(n, {}) for n in names]).collect()}
    spread = np.std(arrays(rows)[1])
    assert set(found) == set(names) and all(v < 0.9 * spread for v in found.values()), found
    with pytest.raises(ValueError, match="no model"):
        regressors.fitted("other", rows, "x", "y")
