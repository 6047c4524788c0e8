"""Sinks, caches and reloads, written to and read back from the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from galeframe.functions import scalar as fx
from galeframe.operators import studies
from galeframe.plans.registry import query, r
from galeframe.sources import storage as so
from galeframe.sources.schema import FORECASTS_SQL, SERIES_SQL, forecasts, site_series, table


def shared(spark) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{so.shared_dir(spark)}/{uuid.uuid4().hex}"


@query("S6_cached_site", f"WITH {SERIES_SQL} SELECT site, count(*) AS n, round(sum(power), 4) AS total FROM series GROUP BY site")
def cached_site(spark, sf_dir):
    folder = shared(spark)
    rows = site_series(spark, sf_dir)
    so.cached(spark, folder, {"table": "events", "rule": 1}, lambda: rows)
    again = so.cached(spark, folder, {"rule": 1, "table": "events"}, lambda: rows.limit(0))
    return again.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r(F.sum("power"), 4).alias("total"))


@query("S8_csv", "SELECT o_orderkey, o_totalprice FROM orders")
def csv(spark, sf_dir):
    path = shared(spark)
    so.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path)
    return so.read_csv(spark, path, "o_orderkey long, o_totalprice double")


@query("S9_strict_json", "SELECT n_nationkey, n_name FROM nation")
def strict_json(spark, sf_dir):
    path = shared(spark)
    so.write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.json(path, schema="n_nationkey int, n_name string")


@query("S10_model_arrays", "SELECT 'w' AS name, 6 AS n, 15.0 AS total UNION ALL SELECT 'b', 1, 2.5")
def model_arrays(spark, sf_dir):
    path = shared(spark)
    so.write_arrays(spark, path, w=np.arange(6.0).reshape(2, 3), b=np.array([2.5]))
    return spark.read.parquet(path).select("name", F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("S13_append_log", "SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def append_log(spark, sf_dir):
    path = shared(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    so.write_csv(rows, path, append=True)
    so.write_csv(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey"), path, append=True)
    return so.read_csv(spark, path, "s_suppkey long")


@query("F28_loss_weights", f"WITH {SERIES_SQL}, n AS (SELECT site, count(*) FILTER (NOT wind > 90) AS ns, count(*) FILTER (wind > 90) AS nt FROM series GROUP BY site) SELECT site, round(1 / (2.0 * ns), 9) AS source_weight, round(1 / (2.0 * nt), 9) AS target_weight FROM n")
def loss_weights(spark, sf_dir):
    counts = site_series(spark, sf_dir).groupBy("site").agg(F.count_if(~(F.col("wind") > 90)).alias("ns"), F.count_if(F.col("wind") > 90).alias("nt")).collect()
    rows = [(c["site"], *(round(w, 9) for w in fx.loss_weights(c["ns"], c["nt"], 1.0, "domain_balanced"))) for c in counts]
    return spark.createDataFrame(rows, "site int, source_weight double, target_weight double")


@query("F29_training_checks", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_width, count(*) FILTER (list_contains(list_transform(embedding, lambda v: isnan(v)), true)) AS not_finite FROM embeddings")
def training_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong_width"), F.count_if(F.exists("embedding", F.isnan)).alias("not_finite"))


@query("T27_ablation_variants", "SELECT * FROM (VALUES ('Full', 1.0::DOUBLE, 0.5::DOUBLE), ('NoVariance', 0.0, 0.5), ('NoDiscrepancy', 1.0, 0.0), ('Weighted', 0.0, 0.0)) t(variant, variance, discrepancy)")
def ablation_variants(spark, sf_dir):
    return spark.createDataFrame(studies.variants(1.0, 0.5), "variant string, variance double, discrepancy double")


@query("T33_probability_tuning", f"WITH {FORECASTS_SQL}, c AS (SELECT task, scale, avg((greatest(0.1 * (y - (prediction - scale)), (0.1 - 1) * (y - (prediction - scale))) + greatest(0.9 * (y - (prediction + scale)), (0.9 - 1) * (y - (prediction + scale)))) / 2) AS score FROM forecasts, (VALUES (2.0::DOUBLE), (8.0::DOUBLE), (20.0::DOUBLE)) t(scale) WHERE seed <= 3 GROUP BY task, scale) SELECT task, scale FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(score, 9), scale) AS k FROM c) WHERE k = 1")
def probability_tuning(spark, sf_dir):
    return studies.tune_width(forecasts(spark, sf_dir).where("seed <= 3"), [2.0, 8.0, 20.0], 0.1)


@query("T24_search")
def search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return studies.ridge_search(spark, rows, [0.01, 1.0, 100.0], seed=1)
