"""Block inference against enumeration of all resamples and sign patterns, and plain loops over the rows."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.functions.scalar import stable_seed
from galeframe.operators import inference

DRAWS = 20_000
START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """(task, site, method, seed, window, ts, y, prediction): two seeds, three methods, four blocks of unequal size."""
    r = np.random.default_rng(12)
    out = []
    for site in (0, 1):
        for w in range(30):
            y = float(r.uniform(0, 50))
            for method, spread in (("A", 3.0), ("R", 3.6), ("N", 9.0)):
                for seed in (1, 2):
                    if (method, site, w) != ("N", 0, 4):  # one window of N is missing
                        out.append((f"site{site}", site, method, seed, w, START + dt.timedelta(days=w), y, y + float(r.normal(0, spread))))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "task string, site int, method string, seed int, window_index int, ts date, y double, prediction double").repartition(5).cache()


def block():
    return F.floor(F.col("window_index") / 8)


def by_hand(rows):
    """(task, method) -> block -> (sum, number) of the differences of seed-mean squared errors, A minus the other."""
    loss: dict = {}
    for task, _, method, _, w, _, y, p in rows:
        loss.setdefault((task, method, w), []).append((p - y) ** 2)
    out: dict = {}
    for (task, method, w), own in loss.items():
        if method != "A" and (task, "A", w) in loss:
            s, n = out.setdefault((task, method), {}).get(w // 8, (0.0, 0))
            out[task, method][w // 8] = (s + float(np.mean(loss[task, "A", w]) - np.mean(own)), n + 1)
    return out


def inferred(frame, seed=3, root=False):
    sums = inference.block_sums(inference.paired_differences(frame, "A"), ["task", "method"], block(), F.col("difference"))
    return {(x.task, x.method): x for x in inference.block_inference(sums, ["task", "method"], DRAWS, seed, root=root).collect()}


@pytest.mark.parametrize("root", [False, True])
def test_bootstrap_equals_all_resamples(frame, rows, root):
    found, blocks = inferred(frame, root=root), by_hand(rows)
    assert set(found) == set(blocks) and len(found) == 4
    shape = (lambda v: math.copysign(math.sqrt(abs(v)), v)) if root else (lambda v: v)
    for key, own in blocks.items():
        cells = [own[b] for b in sorted(own)]
        every = sorted(shape(sum(cells[i][0] for i in pick) / sum(cells[i][1] for i in pick)) for pick in itertools.product(range(4), repeat=4))
        assert found[key].blocks == 4 and found[key].observed == pytest.approx(shape(sum(s for s, _ in cells) / sum(n for _, n in cells)), rel=1e-12)
        # the interval's ends are quantiles of the 256 equally likely resamples, up to the draws' own error
        for value, share in ((found[key].ci_low, 0.025), (found[key].ci_high, 0.975)):
            low, high = every[int(256 * (share - 0.008))], every[min(255, int(256 * (share + 0.008)))]
            assert low - 1e-9 <= value <= high + 1e-9
        # and exactly those of the same keyed draws, one resample after another
        random, drawn = np.random.default_rng(stable_seed(3, *key)), []
        for at in range(0, DRAWS, inference.DRAWS):
            for pick in random.integers(0, 4, size=(min(inference.DRAWS, DRAWS - at), 4)).tolist():
                drawn.append(shape(sum(cells[i][0] for i in pick) / sum(cells[i][1] for i in pick)))
        assert np.quantile(drawn, [0.025, 0.975]) == pytest.approx([found[key].ci_low, found[key].ci_high], rel=1e-9)


def test_sign_flips_equal_all_patterns(frame, rows):
    found = inferred(frame)
    for key, own in by_hand(rows).items():
        cells = [own[b] for b in sorted(own)]
        n, observed = sum(c[1] for c in cells), sum(c[0] for c in cells) / sum(c[1] for c in cells)
        flips = [sum(s * c[0] for s, c in zip(signs, cells, strict=True)) / n for signs in itertools.product((-1, 1), repeat=4)]
        two = sum(abs(f) >= abs(observed) - 1e-12 for f in flips) / 16
        one = sum(f >= observed - 1e-12 for f in flips) / 16
        assert two >= 2 / 16 and one >= 1 / 16
        for share, p in ((two, found[key].p_two_sided), (one, found[key].p_one_sided)):
            assert p == pytest.approx((1 + share * DRAWS) / (1 + DRAWS), abs=5 * math.sqrt(share * (1 - share) / DRAWS) + 1e-9)
            assert p * (DRAWS + 1) == pytest.approx(round(p * (DRAWS + 1)))  # one is added to a count, and to the draws


def endpoint(rows, capacity, a, b, swapped):
    """Site-equal normalised RMSE of a minus b with the two exchanged in the ``swapped`` (site, block)s, row by row."""
    total = 0.0
    for site in (0, 1):
        per_seed = []
        for seed in (1, 2):
            error = {a: [], b: []}
            for _, s, method, sd, w, _, y, p in rows:
                if s == site and sd == seed and method in error:
                    other = {a: b, b: a}[method] if (s, w // 8) in swapped else method
                    error[other].append((p - y) ** 2)
            per_seed.append(math.sqrt(np.mean(error[a])) - math.sqrt(np.mean(error[b])))
        total += np.mean(per_seed) / capacity[site]
    return total / 2


def test_block_swaps_equal_all_exchanges(spark, frame, rows):
    capacity = {0: 60.0, 1: 90.0}
    table = spark.createDataFrame(list(capacity.items()), "site int, capacity double")
    found = inference.block_swap(frame, "A", "R", block(), table, DRAWS, 5).first()
    levels = [(s, k) for s in (0, 1) for k in range(4)]
    every = [endpoint(rows, capacity, "A", "R", {x for x, on in zip(levels, pattern, strict=True) if on}) for pattern in itertools.product((0, 1), repeat=8)]
    assert found.observed == pytest.approx(every[0], rel=1e-9)
    share = sum(abs(e) >= abs(every[0]) - 1e-12 for e in every) / 256
    assert found.p_value == pytest.approx((1 + share * DRAWS) / (1 + DRAWS), abs=5 * math.sqrt(share * (1 - share) / DRAWS) + 1e-9)


def test_comparisons_are_adjusted_over_all_rows_and_tiers_follow(frame, rows, spark):
    compared = {(x.task, x.method): x for x in inference.reference_comparisons(frame, "A", block(), DRAWS, 7).collect()}
    plain = inferred(frame, seed=7)
    order = sorted(plain, key=lambda k: (plain[k].p_two_sided, k))
    running = 0.0
    for k, key in enumerate(order):
        running = max(running, (len(order) - k) * plain[key].p_two_sided)
        assert compared[key].p_two_sided == plain[key].p_two_sided and compared[key].p_holm == pytest.approx(min(1.0, running))
    scores = spark.createDataFrame([("t", "A", 1.0), ("t", "B", 1.2), ("t", "C", 1.5), ("t", "D", 1.5), ("u", "B", 2.0), ("u", "A", 2.0)], "task string, method string, rmse double")
    p = spark.createDataFrame([("t", "B", 0.20), ("t", "C", 0.01), ("u", "A", 0.001)], "task string, method string, p_holm double")
    tier = {(x.task, x.method): (x.winner, x.p_holm, x.in_first_tier) for x in inference.first_tier(scores, p).collect()}
    assert tier == {
        ("t", "A"): ("A", 1.0, True), ("t", "B"): ("A", 0.20, True), ("t", "C"): ("A", 0.01, False), ("t", "D"): ("A", None, True),  # without a test nobody leaves
        ("u", "A"): ("A", 1.0, True), ("u", "B"): ("A", None, True),
    }
