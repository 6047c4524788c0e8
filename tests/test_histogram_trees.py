"""Boosting over bins against the same by plain loops in NumPy, on the same bins."""

import numpy as np
import pytest

from galeframe.operators import histogram_trees as ht
from galeframe.plans import catalog

from .conftest import SMALL


def invented(n=400, seed=2):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.standard_normal(n), r.integers(0, 4, n), r.uniform(-1, 1, n), np.zeros(n)])
    return x, np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] * x[:, 2] + 0.2 * r.standard_normal(n)


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").repartition(parts)


def quantile(values, tau):
    """The value at rank ceil(tau n)."""
    return np.sort(values)[max(0, int(np.ceil(tau * len(values))) - 1)]


def by_loops(bins, y, rounds, depth, rate, tau, least):
    """Predictions after all rounds: every split of every node tried one by one."""
    fitted = np.full(len(y), y.mean() if tau is None else quantile(y, tau))
    for _ in range(rounds):
        slope = y - fitted if tau is None else np.where(y >= fitted, tau, tau - 1)
        groups = [np.arange(len(y))]
        done = []
        for level in range(depth + 1):
            following = []
            for rows in groups:
                best = (1e-9, None)
                if level < depth:
                    total = slope[rows].sum()
                    tried = []
                    for f in range(bins.shape[1]):
                        for b in range(63):
                            left = bins[rows, f] <= b
                            if least <= left.sum() <= len(rows) - least:
                                tried.append((slope[rows][left].sum() ** 2 / left.sum() + slope[rows][~left].sum() ** 2 / (~left).sum() - total**2 / len(rows), f, b))
                    scale = max([abs(total) ** 2 / len(rows), *(g for g, _, _ in tried), 1e-300])
                    for g, f, b in tried:
                        if round(g / scale, 9) > best[0]:
                            best = (round(g / scale, 9), (f, b))
                if best[1] is None:
                    done.append(rows)
                else:
                    left = bins[rows, best[1][0]] <= best[1][1]
                    following += [rows[left], rows[~left]]
            groups = following
        for rows in done:
            fitted[rows] += rate * (slope[rows].mean() if tau is None else quantile(y[rows] - fitted[rows], tau))
    return fitted


@pytest.mark.parametrize(("tau", "rounds"), [(None, 4), (0.2, 4), (0.9, 13)])
def test_equals_loops_on_the_same_bins(spark, tau, rounds):
    x, y = invented()
    model = ht.boost(frame(spark, x, y), "x", "y", rounds=rounds, depth=2, rate=0.4, tau=tau, least=15)
    assert len(model.trees) == rounds and [len(e) for e in model.edges][1:] == [4, 63, 1]
    found = np.array([r["prediction"] for r in model.predict(frame(spark, x, y), "x").orderBy("id").collect()])
    assert np.allclose(found, by_loops(model.binned(x), y, rounds, 2, 0.4, tau, 15), atol=1e-9)
    if tau is not None:
        assert abs((y <= found).mean() - tau) < 0.06


def test_edges_are_quantiles_and_rows_do_not_depend_on_partitions(spark):
    x, y = invented(300)
    one, many = (ht.boost(frame(spark, x, y, parts), "x", "y", rounds=3, depth=3) for parts in (1, 7))
    assert all(np.array_equal(a, b) for a, b in zip(one.edges, many.edges, strict=True))
    assert all((np.searchsorted(one.edges[0], x[:, 0]) == k).mean() < 0.05 for k in range(64))
    assert [t.feature for t in one.trees] == [t.feature for t in many.trees] and np.allclose([v for t in one.trees for v in t.value], [v for t in many.trees for v in t.value])


def test_missing_rows_and_values(spark):
    x, y = invented(120)
    x[::7, 0] = np.nan
    rows = frame(spark, x, y).unionByName(spark.createDataFrame([(900, None, 1.0), (901, [0.0, 1.0, 0.0, 0.0], None)], "id long, x array<double>, y double"))
    model = ht.boost(rows, "x", "y", rounds=2, depth=2, least=10)
    found = {r["id"]: r["prediction"] for r in model.predict(rows, "x").collect()}
    assert len(found) == 122 and found[900] is None and np.isfinite(found[901]) and all(v is not None and np.isfinite(v) for k, v in found.items() if k != 900)
    empty = ht.boost(rows.where("id < 0"), "x", "y")
    assert {r["prediction"] for r in empty.predict(rows.where("id < 3"), "x").collect()} == {0.0}
    with pytest.raises(ValueError, match="bins"):
        ht.boost(rows, "x", "y", bins=300)


def test_queries_beat_a_constant(spark):
    rows = catalog.QUERIES["T13_histogram_boosting"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "label"), "vec_id").toPandas()
    assert ((rows.prediction - rows.label) ** 2).mean() < 0.9 * rows.label.var() and (rows.lower <= rows.upper).all()
    assert ((rows.label >= rows.lower) & (rows.label <= rows.upper)).mean() > 0.8
