"""Paired block inference, multiplicity and subsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.functions import scalar as fx
from galeframe.operators import inference as inf
from galeframe.operators import stats as st
from galeframe.operators import timeseries as ts
from galeframe.plans.registry import query, r
from galeframe.sources.schema import SERIES_SQL, capacities, forecasts, site_series, table

DRAWS = 999


def _block():
    return fx.week_block(F.col("ts"))


def _differences(spark, sf_dir):
    return inf.block_sums(inf.paired_differences(forecasts(spark, sf_dir), "A"), ["task", "method"], _block(), F.col("difference"))


@query("I1_block_bootstrap")
def block_bootstrap(spark, sf_dir):
    return inf.block_inference(_differences(spark, sf_dir), ["task", "method"], DRAWS, 1).select("task", "method", "blocks", "observed", "ci_low", "ci_high")


@query("I2_rmse_bootstrap")
def rmse_bootstrap(spark, sf_dir):
    return inf.block_inference(_differences(spark, sf_dir), ["task", "method"], DRAWS, 2, root=True).select("task", "method", "observed", "ci_low", "ci_high")


@query("I3_sign_flip")
def sign_flip(spark, sf_dir):
    return inf.block_inference(_differences(spark, sf_dir), ["task", "method"], DRAWS, 3).select("task", "method", "p_two_sided", "p_one_sided")


@query("I4_block_swap")
def block_swap(spark, sf_dir):
    return inf.block_swap(forecasts(spark, sf_dir), "A", "R", _block(), capacities(spark), DRAWS, 4)


@query(
    "I5_holm",
    """WITH p AS (SELECT o_orderpriority AS family, o_custkey AS k, round(avg(o_totalprice) / 500000 / 5000, 12) AS p FROM orders GROUP BY ALL),
        w AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, k) AS rn, count(*) OVER (PARTITION BY family) AS m FROM p)
        SELECT family, k, round(least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY family ORDER BY rn)), 9) AS p_holm FROM w""",
)
def holm(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("k")).agg(F.round(F.avg("o_totalprice") / 500000 / 5000, 12).alias("p"))
    return st.holm(p, ["family"], "p", ["k"]).select("family", "k", F.round("p_holm", 9).alias("p_holm"))


@query("I6_first_tier")
def first_tier(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    tested = inf.reference_comparisons(rows, "A", _block(), DRAWS, 6)
    return inf.first_tier(st.squared_errors(rows).select("task", "method", r("rmse").alias("rmse")), tested)


@query("I7_reference_comparisons")
def reference_comparisons(spark, sf_dir):
    return inf.reference_comparisons(forecasts(spark, sf_dir), "A", _block(), DRAWS, 7)


@query(
    "I9_ratio_subsample",
    f"""WITH {SERIES_SQL}, x AS (SELECT raw_row, coalesce(wind > 90, false) AS is_target, wind IS NULL AS unknown FROM series),
        k AS (SELECT *, row_number() OVER (PARTITION BY is_target ORDER BY md5('9|' || raw_row), raw_row) AS k FROM x WHERE NOT unknown),
        n AS (SELECT count(*) FILTER (is_target) AS t, (SELECT count(*) FROM x) AS total FROM x),
        c AS (SELECT t, total - t AS s, 150 AS want_t, 350 AS want_s FROM n),
        d AS (SELECT least(want_t, t) + least(greatest(350 - s, 0), greatest(t - 150, 0)) AS nt, least(want_s, s) + least(greatest(150 - t, 0), greatest(s - 350, 0)) AS ns FROM c)
        SELECT raw_row, is_target FROM k, d WHERE k <= CASE WHEN is_target THEN nt ELSE ns END""",
)
def ratio_subsample(spark, sf_dir):
    """A fixed number of rows with a share of target rows, by hash order."""
    rows = site_series(spark, sf_dir).withColumn("is_target", F.col("wind") > 90)
    n_target, n = rows.agg(F.count_if("is_target"), F.count(F.lit(1))).first()
    source, target = inf.subsample_counts(n - n_target, n_target, 500, 0.3)
    order = ts.hashed_order("raw_row", 9)
    a = rows.where(~F.col("is_target")).orderBy(*order).limit(source)
    return a.unionByName(rows.where("is_target").orderBy(*order).limit(target)).select("raw_row", "is_target")


@query("I10_random_subsample", f"WITH {SERIES_SQL} SELECT raw_row FROM series ORDER BY md5('10|' || raw_row), raw_row LIMIT 800")
def random_subsample(spark, sf_dir):
    return site_series(spark, sf_dir).orderBy(*ts.hashed_order("raw_row", 10)).limit(800).select("raw_row")
