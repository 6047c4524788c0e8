"""Sources, parsing, projection and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.functions import scalar as fx
from galeframe.operators import joins as jx
from galeframe.plans.registry import query, r
from galeframe.sources import schema as sx
from galeframe.sources.schema import CAPACITY_SQL, FORECASTS_SQL, SERIES_SQL, Protocol, site_series, table


@query("S1_scan", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def scan(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("S2_scan_projection", "SELECT event_id, ts, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def scan_projection(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


@query(
    "S3_capacity_from_name",
    "SELECT c_name, CAST(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS INTEGER) AS capacity FROM customer ORDER BY capacity DESC",
)
def capacity_from_name(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_name", F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("int").alias("capacity"))
    return names.orderBy(F.desc("capacity"))


@query("S4_fuzzy_columns", "SELECT l_orderkey, l_extendedprice AS price, l_shipdate AS shipped FROM lineitem")
def fuzzy_columns(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    found = {name: sx.find_column(line.columns, *words) for name, words in {"l_orderkey": ("order", "key"), "price": ("extended", "price"), "shipped": ("ship", "date"), "nothing": ("wind", "hub")}.items()}
    return line.select(*(F.col(c).alias(n) for n, c in found.items() if c))


@query("S5_strict_columns", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders")
def strict_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = sx.resolve_columns(orders.columns, {"id": " O_ORDERKEY", "total": "o_total price"})
    return orders.select(*(F.col(c).alias(n) for n, c in found.items()))


@query("S14_union_of_sites", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY event_type")
def union_of_sites(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sx.union_of_sites([events.where(F.col("event_type") == k) for k in ("click", "view", "error")]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("S15_missing_records", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def missing_records(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(
    "F1_hour_24",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)
                             WHEN event_id % 5 = 1 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""",
)
def hour_24(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" 24:00"))).when(F.col("event_id") % 5 == 1, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events.select("event_id", fx.parse_timestamp(text).alias("parsed"))


@query("F2_lenient_number", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events")
def lenient_number(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", fx.number(text).alias("number"))


@query("F3_range", f"WITH {SERIES_SQL} SELECT raw_row, CASE WHEN wind = 50 OR wind < 10 OR wind > 90 THEN NULL ELSE wind END AS wind FROM series")
def value_range(spark, sf_dir):
    return site_series(spark, sf_dir).select("raw_row", fx.in_range(F.col("wind"), 10, 90, sentinel=50.0).alias("wind"))


@query("F4_all_zero", "SELECT l_orderkey, l_linenumber, coalesce(l_discount = 0, false) AND coalesce(l_tax = 0, false) AS all_zero FROM lineitem")
def all_zero(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fx.all_zero(F.col("l_discount"), F.col("l_tax")).alias("all_zero"))


@query("F5_keep_unrepeated", "SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def keep_unrepeated(spark, sf_dir):
    return jx.keep_unrepeated(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("F6_duplicate_keys", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return jx.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("F7_cyclic", f"WITH {SERIES_SQL} SELECT raw_row, round(sin(radians(wind * 3.6)), 6) + 0.0 AS dir_sin, round(cos(radians(wind * 3.6)), 6) + 0.0 AS dir_cos FROM series")
def cyclic(spark, sf_dir):
    s, c = fx.cyclic(F.col("wind") * 3.6)
    return site_series(spark, sf_dir).select("raw_row", r(s).alias("dir_sin"), r(c).alias("dir_cos"))


@query("F8_feature_set", f"WITH {SERIES_SQL} SELECT raw_row, wind, round(sin(radians(wind * 3.6)), 6) + 0.0 AS direction_sin, round(cos(radians(wind * 3.6)), 6) + 0.0 AS direction_cos FROM series")
def feature_set(spark, sf_dir):
    rows = site_series(spark, sf_dir).withColumn("direction", F.col("wind") * 3.6)
    chosen = rows.select("raw_row", *fx.feature_columns(rows.columns, "full_dir_cyclic"))
    return chosen.withColumns({c: r(c) for c in ("direction_sin", "direction_cos")})


_SPLIT_SQL = "CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-16' THEN 'validation' WHEN ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-21' THEN 'calibration' WHEN ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-02-01' THEN 'test' ELSE 'outside' END"


@query("F9_split_label", f"WITH {SERIES_SQL} SELECT {_SPLIT_SQL} AS split, count(*) AS n FROM series GROUP BY 1")
def split_label(spark, sf_dir):
    return site_series(spark, sf_dir).groupBy(fx.split_label(F.col("ts"), Protocol()).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("F10_domain_mask", f"WITH {SERIES_SQL} SELECT raw_row FROM series WHERE {_SPLIT_SQL} = 'train' AND wind > 90")
def domain_mask(spark, sf_dir):
    rows = site_series(spark, sf_dir)
    return rows.where(fx.domain_mask(fx.split_label(F.col("ts"), Protocol()), F.col("wind") > 90, "train", "target")).select("raw_row")


@query(
    "F11_first_reason",
    f"""WITH {SERIES_SQL} SELECT CASE WHEN raw_row % 11 = 0 THEN 'non_contiguous' WHEN power < 1 THEN 'invalid_power' WHEN wind < 5 THEN 'missing_domain_weather'
        WHEN {_SPLIT_SQL} = 'outside' THEN 'outside_period' ELSE 'accepted' END AS reason, count(*) AS n FROM series GROUP BY 1""",
)
def first_reason(spark, sf_dir):
    reason = fx.first_reason(F.col("raw_row") % 11 == 0, F.col("power") < 1, F.col("wind") < 5, fx.split_label(F.col("ts"), Protocol()) == "outside")
    return site_series(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("F12_event_category", f"WITH {SERIES_SQL} SELECT CASE WHEN wind < 10 THEN 'cold' WHEN wind > 90 THEN 'hot' ELSE 'wind' END AS category, count(*) AS n FROM series GROUP BY 1")
def event_category(spark, sf_dir):
    return site_series(spark, sf_dir).groupBy(fx.event_category(F.col("wind") < 10, F.col("wind") > 90).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F13_calendar_keys",
    """SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season,
              strftime(o_orderdate, '%Y-%m') AS month_key, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter_key, count(*) AS n FROM orders GROUP BY ALL""",
)
def calendar_keys(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(fx.season(d).alias("season"), fx.month_key(d).alias("month_key"), fx.quarter_key(d).alias("quarter_key")).agg(F.count(F.lit(1)).alias("n"))


@query("F14_week_block", "SELECT CAST(floor(date_diff('day', DATE '1970-01-05', CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS block, count(*) AS n FROM lineitem GROUP BY 1")
def week_block(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(fx.week_block(F.col("l_shipdate")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F15_block_from_first",
    """SELECT l_returnflag, CAST(floor(date_diff('day', first_day, CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS block, count(*) AS n
       FROM (SELECT *, min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_returnflag) AS first_day FROM lineitem) GROUP BY ALL""",
)
def block_from_first(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    origin = line.groupBy("l_returnflag").agg(F.min("l_shipdate").alias("first_day"))
    return line.join(F.broadcast(origin), "l_returnflag").groupBy("l_returnflag", fx.block_from(F.col("l_shipdate"), F.col("first_day")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


def _bounds_query(name: str, lower_sql: str, upper_sql: str, pair):
    @query(name, f"WITH {FORECASTS_SQL} SELECT window_index, seed, round({lower_sql}, 6) + 0.0 AS lower_out, round({upper_sql}, 6) + 0.0 AS upper_out FROM forecasts")
    def bounds(spark, sf_dir):
        a, b = pair(F.col("lower"), F.col("upper"))
        return sx.forecasts(spark, sf_dir).select("window_index", "seed", r(a).alias("lower_out"), r(b).alias("upper_out"))

    return bounds


_bounds_query("F16_clip", "greatest(lower, 5.0)", "greatest(least(upper, 60.0), greatest(lower, 5.0))", lambda a, b: fx.clip_bounds(a, b, 5.0, 60.0))
_bounds_query("F17_ordered", "least(upper, lower + 9)", "greatest(upper, lower + 9)", lambda a, b: fx.ordered(b, a + 9))
_bounds_query("F19_width_scale", "(lower + upper) / 2 - (upper - lower) / 2 * 1.3", "(lower + upper) / 2 + (upper - lower) / 2 * 1.3", lambda a, b: fx.scale_width(a, b, 1.3))
_bounds_query("F20_expand", "lower - 2.5", "upper + 2.5", lambda a, b: fx.expand(a, b, F.lit(2.5)))
_bounds_query("F20_expand_scaled", "lower - 0.1 * greatest(upper - lower, 1e-6)", "upper + 0.1 * greatest(upper - lower, 1e-6)", lambda a, b: fx.expand(a, b, F.lit(0.1), scaled=True))


@query("F18_rearranged", f"WITH {FORECASTS_SQL} SELECT window_index, seed, round(list_sort([lower, y, prediction])[1], 6) + 0.0 AS q_low, round(list_sort([lower, y, prediction])[3], 6) + 0.0 AS q_high FROM forecasts")
def rearranged(spark, sf_dir):
    q = fx.rearranged(F.col("lower"), F.col("y"), F.col("prediction"))
    return sx.forecasts(spark, sf_dir).select("window_index", "seed", r(F.get(q, F.lit(0))).alias("q_low"), r(F.get(q, F.lit(2))).alias("q_high"))


@query("F21_standardise", f"WITH {SERIES_SQL}, s AS (SELECT site, avg(power) AS m, stddev_pop(power) AS sd FROM series GROUP BY site) SELECT raw_row, round((coalesce(power, m) - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS z FROM series JOIN s USING (site)")
def standardise(spark, sf_dir):
    rows = site_series(spark, sf_dir)
    stats = rows.groupBy("site").agg(F.avg("power").alias("m"), F.stddev_pop("power").alias("sd"))
    return rows.join(F.broadcast(stats), "site").select("raw_row", r(fx.standardise(F.col("power"), F.col("m"), F.col("sd"))).alias("z"))


@query("F22_noise_sigma", f"WITH {SERIES_SQL} SELECT site, round(sqrt(avg(power * power) / pow(10, 2.0)), 6) + 0.0 AS sigma_20, 0.0 AS sigma_inf FROM series GROUP BY site")
def noise_sigma(spark, sf_dir):
    power = F.avg(F.col("power") * F.col("power"))
    levels = fx.parse_snr("20,inf")
    return site_series(spark, sf_dir).groupBy("site").agg(r(fx.noise_sigma(power, levels[0])).alias("sigma_20"), F.max(fx.noise_sigma(F.col("power"), levels[1])).alias("sigma_inf"))


@query("F23_seeded_noise")
def seeded_noise(spark, sf_dir):
    return site_series(spark, sf_dir).select("raw_row", fx.add_noise(F.col("power"), F.lit(0.5), F.col("raw_row"), 7).alias("noisy"))


@query("F24_stable_seed", "SELECT n_name, substr(sha256('7|' || n_name), 1, 16) AS seed_hex FROM nation")
def stable_seed(spark, sf_dir):
    """The first 8 bytes of the hash that seeds come from, as hex; on the driver they are read as a little-endian integer."""
    digest = F.sha2(F.concat(F.lit("7|"), F.col("n_name")), 256)
    return table(spark, sf_dir, "nation").select("n_name", F.substring(digest, 1, 16).alias("seed_hex"))


@query("F25_seed_values", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 6) + 0.0 AS total FROM lineitem")
def seed_values(spark, sf_dir):
    text = F.concat(F.lit("["), F.col("l_discount"), F.lit(", "), F.col("l_tax"), F.lit("]"))
    total = F.aggregate(fx.seed_values(text), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(total).alias("total"))


@query("F26_violations", f"WITH {SERIES_SQL} SELECT count(*) FILTER (power IS NULL) AS missing_power, count(*) FILTER (wind < 0 OR wind > 100) AS wind_out, count(*) AS n FROM series")
def violations(spark, sf_dir):
    rows = sx.require_columns(site_series(spark, sf_dir), ["power", "wind"])
    return rows.agg(F.count_if(F.col("power").isNull()).alias("missing_power"), F.count_if((F.col("wind") < 0) | (F.col("wind") > 100)).alias("wind_out"), F.count(F.lit(1)).alias("n"))


@query("F27_site_of_task", f"WITH {FORECASTS_SQL} SELECT task, CAST(regexp_extract(task, 'site([0-9]+)$', 1) AS INTEGER) AS site, count(*) AS n FROM forecasts GROUP BY ALL")
def site_of_task(spark, sf_dir):
    return sx.forecasts(spark, sf_dir).groupBy("task", fx.site_of(F.col("task")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F30_direction",
    f"WITH {FORECASTS_SQL} SELECT CASE WHEN prediction < y THEN 'lower' WHEN prediction > y THEN 'higher' ELSE 'equal' END AS direction, abs(prediction - y) <= greatest(0.5, 0.5 * greatest(abs(prediction), abs(y))) AS near, count(*) AS n FROM forecasts GROUP BY ALL",
)
def direction(spark, sf_dir):
    p, y = F.col("prediction"), F.col("y")
    return sx.forecasts(spark, sf_dir).groupBy(fx.direction(p - y).alias("direction"), fx.nearly_equal(p, y, 0.5).alias("near")).agg(F.count(F.lit(1)).alias("n"))


@query("F31_time_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def time_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fx.time_text(F.col("ts")).alias("text"))


@query("J4_lookup", f"WITH {SERIES_SQL}, {CAPACITY_SQL} SELECT raw_row, round(power / capacity, 6) + 0.0 AS share FROM series JOIN capacity USING (site)")
def lookup(spark, sf_dir):
    return site_series(spark, sf_dir).join(F.broadcast(sx.capacities(spark)), "site").select("raw_row", r(F.col("power") / F.col("capacity")).alias("share"))
