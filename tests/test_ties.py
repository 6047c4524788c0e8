"""Queries over a table whose rows are there three times, at the same times and sites, equal their SQL."""

import duckdb
import pandas as pd
import pytest

from galeframe.operators.quantiles import exact_percentiles
from galeframe.plans import catalog

from .conftest import SMALL
from .test_catalogue import comparable


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    # the copies lie one behind another, the last first
    duckdb.execute(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id + k * 60000 AS user_id, event_type, value, props FROM '{SMALL}/events.parquet', range(3) r(k) ORDER BY k DESC, event_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["G18_census", "W8_episodes", "W9_longest_episode", "X1_screen", "X2_rule_masks"])
def test_rows_of_one_time_are_not_left_to_chance(spark, repeated, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{repeated}/events.parquet'")
    expected = connection.execute(catalog.ORACLES[name]).df()
    pd.testing.assert_frame_equal(comparable(catalog.QUERIES[name](spark, repeated).toPandas()), comparable(expected), check_dtype=False, rtol=0, atol=1e-6)


def test_census_and_masks_order_ties_by_row(spark, repeated):
    """The copy of a row at its own time changed nothing: no ramp."""
    found = catalog.QUERIES["X2_rule_masks"](spark, repeated).where("raw_row >= 1000000 AND is_ramp").count()
    assert found == 0


@pytest.mark.parametrize("name", ["G18_census", "X1_screen", "X2_rule_masks"])
def test_ramps_that_differ_by_a_bit_lie_on_their_own_side_of_the_percentile(spark, tmp_path, name):
    """The 90th percentile lies between 0.3 - 0.1 and 0.2, which are neighbours as numbers: interpolation rounds to the larger, which lies above."""
    power = [0.0] * 8 + [0.1, 0.3, 0.0, 0.2]
    rows = ", ".join(f"({k}, TIMESTAMP '2024-01-01' + INTERVAL {k} HOUR, 0, 'view', {p}::DOUBLE, '{{}}')" for k, p in enumerate(power))
    duckdb.execute(f"COPY (SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(user_id AS BIGINT) AS user_id, event_type, value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found, expected = comparable(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), comparable(connection.execute(catalog.ORACLES[name]).df())
    pd.testing.assert_frame_equal(found, expected, check_dtype=False)
    # changes of 0.3 and 0.2 are ramps, and row 9 has the largest power
    if name == "G18_census":
        assert found["n_target"].tolist() == [3, 3]
    else:
        assert sorted(found[found["is_ramp" if name == "X2_rule_masks" else "is_extreme"]]["raw_row"]) == ([10, 11] if name == "X2_rule_masks" else [9, 10, 11])


@pytest.mark.parametrize("side, expected", [("floor", 0.3 - 0.1), ("ceil", 0.2)])
def test_neighbours_of_a_percentile(spark, side, expected):
    rows = spark.createDataFrame([(v,) for v in [0.0] * 9 + [0.3 - 0.1, 0.2, 0.3]] + [(None,)], "v double")
    assert exact_percentiles(rows, [], {"q": ("v", 0.9, side)}).first()["q"] == expected
