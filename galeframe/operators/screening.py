"""Extreme-event screening: thresholds, rule masks, their overlap, and stratified label budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.operators.quantiles import exact_percentiles
from galeframe.operators.timeseries import evenly_timed, ramp


@dataclass(frozen=True)
class Rules:
    """Which rules count, and their thresholds; a quantile (in percent) goes before a fixed value."""

    stat_q: float = 95.0
    stat_on_wind: bool = True
    stat_on_power: bool = True
    ramp_ratio: float = 0.05
    ramp_q: float | None = None
    cut_out: float = 25.0
    temp_q_low: float | None = None
    temp_q_high: float | None = None
    temp_low: float = -10.0
    temp_high: float = 35.0
    temp_requires_wind: bool = False
    use_stat: bool = True
    use_ramp: bool = True
    use_cut_out: bool = True
    use_temp: bool = True


def _above(value: Column, threshold: Column) -> Column:
    return F.coalesce(value > threshold, F.lit(False))


def _below(value: Column, threshold: Column) -> Column:
    return F.coalesce(value < threshold, F.lit(False))


def screen(df: DataFrame, rules: Rules, key: str = "site", ts: str = "ts", capacity: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the flags of each rule and ``is_extreme``, their union. Missing values break no rule.

    Needs power; wind and temperature only as far as the table has them. The
    thresholds are one row a site, and broadcast. A row lies above a percentile
    where it lies above the value next below it, and below one where it lies
    below the value next above it: ramps differ by rounding alone, and an
    interpolated value between two such is one of them. ``ties`` orders rows of a
    site and time, without which their ramps are left to chance.
    """
    rows = ramp(df, "power", [key], [ts, *ties])
    has = set(df.columns)
    wanted = {"__q_power": ("power", rules.stat_q / 100, "floor")}
    fixed_limits = {}
    if "wind" in has:
        wanted["__q_wind"] = ("wind", rules.stat_q / 100, "floor")
    if rules.ramp_q is not None:
        wanted["__q_ramp"] = ("ramp", rules.ramp_q / 100, "floor")
    if "temperature" in has:
        for name, q, fixed, side in (("__t_low", rules.temp_q_low, rules.temp_low, "ceil"), ("__t_high", rules.temp_q_high, rules.temp_high, "floor")):
            if q is None:
                fixed_limits[name] = F.lit(fixed)
            else:
                wanted[name] = ("temperature", q / 100, side)
    rows = rows.join(F.broadcast(exact_percentiles(rows, [key], wanted).withColumns(fixed_limits)), key)
    none = F.lit(False)
    wind_high = _above(F.col("wind"), F.col("__q_wind")) if "wind" in has else none
    stat = (wind_high if rules.stat_on_wind else none) | (_above(F.col("power"), F.col("__q_power")) if rules.stat_on_power else none)
    limit = F.col("__q_ramp") if rules.ramp_q is not None else rules.ramp_ratio * (F.lit(1.0) if capacity is None else capacity)
    temp = (_below(F.col("temperature"), F.col("__t_low")) | _above(F.col("temperature"), F.col("__t_high"))) if "temperature" in has else none
    flags = {
        "is_stat": stat,
        "is_ramp": _above(F.col("ramp"), limit),
        "is_cut_out": _above(F.col("wind"), F.lit(rules.cut_out)) if "wind" in has else none,
        "is_temp": (temp & wind_high) if rules.temp_requires_wind and "wind" in has else temp,
    }
    rows = rows.withColumns(flags)
    used = [n for n, on in zip(flags, (rules.use_stat, rules.use_ramp, rules.use_cut_out, rules.use_temp), strict=True) if on]
    union = none
    for name in used:
        union = union | F.col(name)
    return rows.withColumn("is_extreme", union).drop(*(c for c in rows.columns if c.startswith("__")))


def train_thresholds(df: DataFrame, key: str, split: str, wind_q: float = 0.98, temp_q: tuple[float, float] = (0.02, 0.98)) -> DataFrame:
    """Thresholds of each site from training rows alone."""
    train = F.col(split) == "train"
    pick = lambda c: F.when(train, F.col(c))
    wanted = {"wind_high": ("wind", wind_q)}
    if "temperature" in df.columns:
        wanted |= {"temp_low": ("temperature", temp_q[0]), "temp_high": ("temperature", temp_q[1])}
    return exact_percentiles(df.select(key, *(pick(c).alias(c) for c in dict.fromkeys(c for c, _ in wanted.values()))), [key], wanted)


def apply_thresholds(df: DataFrame, thresholds: DataFrame, key: str, cut_out: float = 25.0) -> DataFrame:
    """Flags hot_wind, cold, hot, cut_out and their union."""
    rows = df.join(F.broadcast(thresholds), key)
    temperature = "temperature" in df.columns
    rows = rows.withColumns(
        {
            "is_wind": _above(F.col("wind"), F.col("wind_high")),
            "is_cold": _below(F.col("temperature"), F.col("temp_low")) if temperature else F.lit(False),
            "is_hot": _above(F.col("temperature"), F.col("temp_high")) if temperature else F.lit(False),
            "is_cut_out": _above(F.col("wind"), F.lit(cut_out)),
        }
    )
    return rows.withColumn("is_extreme", F.col("is_wind") | F.col("is_cold") | F.col("is_hot") | F.col("is_cut_out"))


def largest_remainder(cells: DataFrame, key: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Adds ``quota``: one to each cell of a key, the rest in proportion to what is left, by exact largest remainders.

    Ties go to the cell that stands first in ``order``. The budget is cut to the
    number of rows; a key with more cells than budget raises an error.
    """
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    left = (F.col(size) - 1).cast("long")
    rows = cells.withColumns({"__left": left, "__total": F.sum(left).over(w), "__cells": F.count(F.lit(1)).over(w), "__rows": F.sum(size).over(w)})
    effective = F.least(F.lit(budget), F.col("__rows"))
    checked = F.when(effective < F.col("__cells"), F.raise_error(F.lit("budget below the number of cells"))).otherwise(effective - F.col("__cells"))
    rows = rows.withColumn("__rest", checked.cast("long"))
    product = F.col("__rest") * F.col("__left")
    whole = F.when(F.col("__total") > 0, F.expr("CAST(__rest * __left AS BIGINT) DIV __total")).otherwise(F.lit(0))
    rows = rows.withColumns({"__whole": whole.cast("long"), "__part": F.when(F.col("__total") > 0, product % F.col("__total")).otherwise(F.lit(0))})
    rows = rows.withColumn("__over", F.col("__rest") - F.sum("__whole").over(w))
    room = F.col("__whole") < F.col("__left")
    rank = F.row_number().over(w.orderBy(F.desc(room), F.desc("__part"), *order))
    return rows.withColumn("__rank", rank).withColumn("quota", (1 + F.col("__whole") + F.when(room & (F.col("__rank") <= F.col("__over")), 1).otherwise(0)).cast("long")).drop(*(f"__{n}" for n in ("left", "total", "cells", "rows", "rest", "whole", "part", "over", "rank")))


def stratified_labels(df: DataFrame, key: list[str], month: str, event: str, ts: str, budget: int) -> DataFrame:
    """The label budget of each key: month by event cells, largest remainders, evenly timed rows in each cell."""
    cell = [*key, month, event]
    quotas = largest_remainder(df.groupBy(*cell).agg(F.count(F.lit(1)).alias("size")), key, [month, event], "size", budget).select(*cell, "quota")
    return evenly_timed(df.join(F.broadcast(quotas), cell), cell, ts, "quota")  # a row a cell, and no more cells than budget
