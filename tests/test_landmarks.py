"""Landmarks against k-means of many starts in NumPy."""

import numpy as np
import pytest

from galeframe.operators.landmarks import squared, weighted_landmarks
from galeframe.plans import catalog

from .conftest import SMALL


def cheapest(x, w, k, starts=60):
    best, r = np.inf, np.random.default_rng(0)
    for _ in range(starts):
        c = x[r.choice(len(x), k, replace=False)]
        for _ in range(60):
            own = squared(x, c).argmin(axis=1)
            c = np.array([np.average(x[own == i], axis=0, weights=w[own == i]) if (own == i).any() else c[i] for i in range(k)])
        best = min(best, float(w @ squared(x, c).min(axis=1)))
    return best


def frame(spark, x, w):
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, w, strict=True)], "x array<double>, w double").repartition(5)


def test_cost_is_that_of_the_best_of_many_starts(spark):
    r = np.random.default_rng(3)
    places = r.standard_normal((6, 4)) * 12
    x = np.vstack([p + r.standard_normal((n, 4)) for p, n in zip(places, [5, 200, 40, 8, 60, 30], strict=True)])
    w = r.uniform(0.1, 2.0, len(x))
    centres, cost = weighted_landmarks(frame(spark, x, w), "x", 6, seed=1, weight="w")
    assert centres.shape == (6, 4) and cost == pytest.approx(cheapest(x, w, 6), rel=1e-6)
    assert cost == pytest.approx(float(w @ squared(x, centres).min(axis=1)), rel=1e-9)
    again, _ = weighted_landmarks(frame(spark, x, w).repartition(2), "x", 6, seed=1, weight="w")
    assert np.allclose(np.sort(again, axis=0), np.sort(centres, axis=0))


def test_weights_decide_where_landmarks_stand(spark):
    x = np.concatenate([np.zeros(900), np.ones(50) * 10, np.ones(50) * 11])[:, None] + np.linspace(0, 0.01, 1000)[:, None]
    plain, _ = weighted_landmarks(frame(spark, x, np.ones(1000)), "x", 2, seed=2)
    assert sorted(np.round(plain[:, 0])) in ([0, 10], [0, 11])
    heavy = np.where(x[:, 0] > 5, 1e4, 1e-4)
    found, _ = weighted_landmarks(frame(spark, x, heavy), "x", 2, seed=2, weight="w")
    assert sorted(np.round(found[:, 0])) == [10, 11]


def test_few_rows_repeats_and_missing_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 1.0)] * 30 + [([3.0, 4.0], 1.0), (None, 1.0), ([9.0, 9.0], 0.0), ([9.0, 9.0], None)], "x array<double>, w double")
    centres, cost = weighted_landmarks(rows, "x", 8, weight="w", starts=2)
    assert sorted(map(tuple, centres)) == [(1, 2), (3, 4)] and cost == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError, match="no rows"):
        weighted_landmarks(rows.where("w > 5"), "x", 3, weight="w")


def test_the_query_gives_eight(spark):
    assert catalog.QUERIES["T1_landmarks"](spark, SMALL).count() == 8
