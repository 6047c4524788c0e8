import os

import duckdb
import pandas as pd
import pytest

from galeframe.plans import catalog

from .conftest import SMALL


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return connection


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(str)
        elif df[c].dtype != bool:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    found = catalog.QUERIES[name](spark, SMALL).toPandas()
    expected = sql.execute(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(comparable(found), comparable(expected), check_dtype=False, rtol=0, atol=1e-6)


@pytest.mark.parametrize("name", ["W10_separate_segments", "W15_evenly_timed", "I3_sign_flip", "T4_pinball_fits"])
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["T4_domain_fits", "T27_fitted_variants", "T26_extended_fits"])
def test_fits_end_certified(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL)
    rows = (rows.where("attempt = 1 OR converged") if "attempt" in rows.columns else rows).collect()
    assert rows and all(r.converged and r.dual <= r.primal + 1e-9 for r in rows)  # equal but for rounding


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
