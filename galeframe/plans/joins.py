"""Alignment, gathering, key sets, ordering and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.operators import joins as jx
from galeframe.plans.registry import query, r
from galeframe.sources.schema import FORECASTS_SQL, SERIES_SQL, forecasts, site_series, table


@query("J1_aligned", "SELECT o_orderkey, round(a.v - b.v, 6) + 0.0 AS difference FROM (SELECT o_orderkey, o_totalprice AS v FROM orders) a JOIN (SELECT o_orderkey, o_totalprice * 0.5 AS v FROM orders) b USING (o_orderkey)")
def aligned(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pair = jx.aligned(orders.select("o_orderkey", F.col("o_totalprice").alias("v")), orders.select("o_orderkey", (F.col("o_totalprice") * 0.5).alias("v")), ["o_orderkey"], "v")
    return pair.select("o_orderkey", r(F.col("value_a") - F.col("value_b")).alias("difference"))


@query("J2_gather", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def gather(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber")
    return line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("J3_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("J3_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("J5_method_pairs", f"WITH {FORECASTS_SQL}, m AS (SELECT DISTINCT task, method FROM forecasts) SELECT a.task, a.method AS method_a, b.method AS method_b FROM m a JOIN m b ON a.task = b.task AND a.method < b.method")
def method_pairs(spark, sf_dir):
    return jx.method_pairs(forecasts(spark, sf_dir), ["task"], "method")


@query("J5_design", f"WITH {FORECASTS_SQL} SELECT task, seed, t.tau FROM (SELECT DISTINCT task FROM forecasts), (SELECT DISTINCT seed FROM forecasts), (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) t(tau)")
def design(spark, sf_dir):
    """A cartesian design: three small lists of settings, not rows of data."""
    rows = forecasts(spark, sf_dir)
    return rows.select("task").distinct().crossJoin(rows.select("seed").distinct()).select("*", F.explode(F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("tau"))


_KERNEL_SQL = "WITH l AS (SELECT vec_id AS landmark, embedding AS c FROM embeddings ORDER BY vec_id LIMIT 16), k AS (SELECT vec_id, landmark, exp(-0.02 * list_sum(list_transform(list_zip(embedding, c), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS kernel FROM embeddings, l)"


def _kernel(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    return jx.kernel_rows(rows, rows.orderBy("vec_id").limit(16), "x", 0.02, "vec_id")


@query("J6_kernel", f"{_KERNEL_SQL} SELECT vec_id, landmark, round(kernel, 6) + 0.0 AS kernel FROM k")
def kernel(spark, sf_dir):
    return _kernel(spark, sf_dir).select("vec_id", "landmark", r("kernel").alias("kernel"))


@query("J17_nearest_landmarks", f"{_KERNEL_SQL} SELECT vec_id, landmark, place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(kernel, 9) DESC, landmark) AS place FROM k) WHERE place <= 3")
def nearest_landmarks(spark, sf_dir):
    return jx.nearest_landmarks(_kernel(spark, sf_dir).withColumn("kernel", F.round("kernel", 9)), "vec_id", 3).select("vec_id", "landmark", F.col("place").cast("long").alias("place"))


@query("J7_union", "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")))


@query("J8_replace_row", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT n_nationkey, upper(n_name) || '!' FROM nation WHERE n_nationkey = 3")
def replace_row(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return jx.replace_row(nation, nation.where("n_nationkey = 3").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), "n_nationkey").orderBy("n_nationkey")


@query("J9_key_difference", "SELECT o_custkey AS k, 'extra' AS status FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def key_difference(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return jx.key_difference(expected, table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")), ["k"])


@query("J9_intersect", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("J10_ranked_order", "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS place FROM orders")
def ranked_order(spark, sf_dir):
    custom = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    w = Window.partitionBy(F.col("o_custkey") % 4).orderBy(custom, F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("J12_pivot", f"WITH {FORECASTS_SQL} SELECT task, round(avg(y) FILTER (method = 'A'), 6) AS a, round(avg(y) FILTER (method = 'N'), 6) AS n, round(avg(y) FILTER (method = 'R'), 6) AS r FROM forecasts GROUP BY task")
def pivot(spark, sf_dir):
    wide = forecasts(spark, sf_dir).groupBy("task").pivot("method", ["A", "N", "R"]).agg(F.round(F.avg("y"), 6))
    return wide.select("task", *(F.col(m).alias(m.lower()) for m in ("A", "N", "R")))


@query("J13_unpivot", f"WITH {FORECASTS_SQL} SELECT window_index, seed, 'lower' AS bound, round(lower, 6) AS value FROM forecasts UNION ALL SELECT window_index, seed, 'upper', round(upper, 6) FROM forecasts")
def unpivot(spark, sf_dir):
    rows = forecasts(spark, sf_dir).select("window_index", "seed", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))
    return rows.unpivot(["window_index", "seed"], ["lower", "upper"], "bound", "value")


@query("J14_first_by_signature", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def first_by_signature(spark, sf_dir):
    return jx.first_by_signature(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("J15_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "J16_alias",
    "WITH RECURSIVE a AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - 1 END AS alias, CASE WHEN n_nationkey % 5 = 0 THEN n_name END AS v FROM nation), c AS (SELECT k, alias, v, 0 AS d FROM a UNION ALL SELECT c.k, a.alias, a.v, d + 1 FROM c JOIN a ON c.alias = a.k WHERE d < 4) SELECT k, max(v) AS v FROM c GROUP BY k",
)
def alias(spark, sf_dir):
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(key.alias("k"), F.when(key % 5 != 0, key - 1).alias("alias"), F.when(key % 5 == 0, F.col("n_name")).alias("v"))
    return jx.resolve_alias(rows, "k", "alias", "v")


@query("J18_as_of", f"WITH {SERIES_SQL}, c AS (SELECT * FROM series WHERE event_type = 'click'), e AS (SELECT * FROM series WHERE event_type = 'error') SELECT e.raw_row, c.power AS last_power FROM e ASOF LEFT JOIN c ON e.site = c.site AND e.ts >= c.ts")
def as_of(spark, sf_dir):
    """The last click at or before each error of a site: one sorted pass over both kinds instead of a join of ranges."""
    rows = site_series(spark, sf_dir).where("event_type IN ('click', 'error')")
    click = F.col("event_type") == "click"
    w = Window.partitionBy("site").orderBy("ts", F.when(click, 0).otherwise(1))
    seen = rows.withColumn("last_power", F.last(F.when(click, F.col("power")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where(~click).select("raw_row", "last_power")
