"""Column resolution, protocols and the tables that the queries read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def find_column(columns: list[str], *keywords: str) -> str | None:
    """The first column whose lower-cased name holds every keyword, or None."""
    wanted = [k.lower() for k in keywords]
    return next((c for c in columns if all(k in c.lower() for k in wanted)), None)


def normalised(name: str) -> str:
    return "".join(name.lower().split())


def resolve_columns(columns: list[str], required: dict[str, str]) -> dict[str, str]:
    """Role -> actual column, by names compared without case and white space; every missing name is told."""
    by_name = {normalised(c): c for c in columns}
    missing = [title for title in required.values() if normalised(title) not in by_name]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return {role: by_name[normalised(title)] for role, title in required.items()}


def require_columns(df: DataFrame, names: list[str], what: str = "frame") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def union_of_sites(frames: list[DataFrame]) -> DataFrame:
    """All sites in one frame; every one must have the same columns in the same order."""
    if not frames:
        raise ValueError("no sites")
    out = frames[0]
    for frame in frames[1:]:
        if frame.columns != out.columns:
            raise ValueError(f"sites differ in columns: {out.columns} and {frame.columns}")
        out = out.unionByName(frame)
    return out


@dataclass(frozen=True)
class Protocol:
    """Half-open split boundaries and the settings of a chronological study."""

    names: tuple[str, ...] = ("train", "validation", "calibration", "test")
    boundaries: tuple[str, ...] = ("2024-01-01", "2024-01-11", "2024-01-16", "2024-01-21", "2024-02-01")
    window: int = 6
    step_minutes: int = 15
    wind_quantile: float = 0.98
    temperature_quantiles: tuple[float, float] = (0.02, 0.98)
    cut_out: float = 25.0

    def __post_init__(self):
        if len(self.boundaries) != len(self.names) + 1:
            raise ValueError("one boundary more than split names is needed")
        if any(a >= b for a, b in zip(self.boundaries, self.boundaries[1:], strict=False)):
            raise ValueError("boundaries must increase strictly")
        if self.window < 1 or not 0 < self.wind_quantile < 1:
            raise ValueError("window and quantile out of range")


def clean(column: Column) -> Column:
    """NaN and infinities as NULL: Spark orders NaN above every number, and aggregates would pass it on."""
    value = column.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


# --- the driver's tables in the roles of the domain

N_SITES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval measurements: site, ts, power, wind, and the raw row number."""
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(N_SITES)).cast("int").alias("site"),
        F.col("event_id").alias("raw_row"),
        "ts",
        clean(F.col("value")).alias("power"),
        F.get_json_object("props", "$.k").cast("double").alias("wind"),
        "event_type",
    )


SERIES_SQL = """series AS (
    SELECT CAST(user_id % 6 AS INTEGER) AS site, event_id AS raw_row, ts, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS power,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) AS wind, event_type
    FROM events)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts with bounds: task, method, seed, window_index, y, prediction, lower, upper, site, ts."""
    line = table(spark, sf_dir, "lineitem")
    y = F.col("l_extendedprice") / 1000
    guess = F.col("l_quantity") * 1.5
    half = 4 + F.col("l_discount") * 100
    return line.select(
        F.concat(F.lit("site"), F.pmod("l_suppkey", F.lit(N_SITES)).cast("string")).alias("task"),
        F.pmod("l_suppkey", F.lit(N_SITES)).cast("int").alias("site"),
        F.col("l_returnflag").alias("method"),
        F.col("l_linenumber").cast("int").alias("seed"),
        F.col("l_orderkey").alias("window_index"),
        F.col("l_shipdate").alias("ts"),
        y.alias("y"),
        guess.alias("prediction"),
        (guess - half).alias("lower"),
        (guess + half).alias("upper"),
    )


FORECASTS_SQL = """forecasts AS (
    SELECT 'site' || CAST(l_suppkey % 6 AS VARCHAR) AS task, CAST(l_suppkey % 6 AS INTEGER) AS site, l_returnflag AS method, CAST(l_linenumber AS INTEGER) AS seed,
           l_orderkey AS window_index, l_shipdate AS ts, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS prediction,
           l_quantity * 1.5 - (4 + l_discount * 100) AS lower, l_quantity * 1.5 + (4 + l_discount * 100) AS upper
    FROM lineitem)"""


def capacities(spark: SparkSession) -> DataFrame:
    """The site dimension, one row a site."""
    return spark.range(N_SITES).select(F.col("id").cast("int").alias("site"), (F.lit(50.0) + F.col("id") * 30).alias("capacity"))


CAPACITY_SQL = "capacity AS (SELECT CAST(range AS INTEGER) AS site, 50.0 + range * 30 AS capacity FROM range(6))"
