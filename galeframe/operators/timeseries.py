"""Ordered analytics over (site, ts): lag windows, episodes, segments, splits and samples.

Where an operator looks back a bounded time, or can be merged from parts, it is
partitioned by (site, stretch of time); where it looks back a number of rows, or
needs their positions, by (site, range of the order) with what came before the
range carried in. So a site with a third of all rows is many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.operators.ranges import RANGE, in_ranges, joined_cells, over_keys, own_rows, positions, with_neighbours

STRETCH_DAYS = 7


def _by(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def lag_windows(df: DataFrame, features: list[str], width: int, keys: list[str], order: list[str], flat: bool = True) -> DataFrame:
    """Each row with the features of the ``width`` rows before it, oldest first; rows without so many are left out.

    A missing feature stays as a NULL in its place, since structs are collected.
    """
    ranged = with_neighbours(in_ranges(df, keys, order), before=width)
    rows = own_rows(ranged, ranged.frame.withColumn("lags", F.collect_list(F.array(*features)).over(ranged.window().rowsBetween(-width, -1)))).where(F.size("lags") == width)
    return rows.withColumn("lags", F.flatten("lags")) if flat else rows


def contiguous_lag_windows(df: DataFrame, features: list[str], width: int, step_seconds: int, keys: list[str], ts: str = "ts", stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Lag windows whose rows, the target included, are exactly one step apart.

    A window spans width * step seconds, so a stretch of time needs only so much
    of the stretch before it: rows near a border are also dealt to the next one.
    """
    span = width * step_seconds
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    size = stretch_days * 86_400_000_000
    own = F.floor(at / size)
    dealt = df.withColumn("__stretch", F.explode(F.array_distinct(F.array(own, F.floor((at + span * 1_000_000) / size))))).withColumn("__own", F.col("__stretch") == own)
    order = _by([*keys, "__stretch"], [ts])
    step = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(order))
    marked = dealt.withColumn("__good", F.coalesce((step == step_seconds * 1_000_000).cast("int"), F.lit(0)))
    run = order.rowsBetween(-(width - 1), 0)
    rows = marked.withColumn("__run", F.sum("__good").over(run)).withColumn("lags", F.collect_list(F.array(*features)).over(order.rowsBetween(-width, -1)))
    kept = rows.where(F.col("__own") & (F.col("__run") == width) & (F.size("lags") == width))
    return kept.withColumn("lags", F.flatten("lags")).drop("__stretch", "__own", "__good", "__run")


def append_lag(df: DataFrame, extra: DataFrame, column: str, width: int, step_seconds: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """Adds to each window in ``df`` the lags of one more column of ``extra``; a window whose rows ``extra`` lacks is left out."""
    more = contiguous_lag_windows(extra, [column], width, step_seconds, keys, ts).select(*keys, ts, F.col("lags").alias("__more"))
    return df.join(more, [*keys, ts]).withColumn("lags", F.concat("lags", "__more")).drop("__more")


def ramp(df: DataFrame, column: str, keys: list[str], order: list[str], name: str = "ramp") -> DataFrame:
    """Absolute change since the row before; 0 in the first row."""
    ranged = with_neighbours(in_ranges(df, keys, order), before=1)
    return own_rows(ranged, ranged.frame.withColumn(name, F.abs(F.col(column) - F.coalesce(F.lag(column).over(ranged.window()), F.col(column)))))


def episodes(df: DataFrame, keys: list[str], ts: str, step_seconds: int, counts: dict[str, Column] | None = None, at_most: bool = False, stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Maximal runs of rows exactly one step apart (``at_most``: one step or less): start, end, n_rows and sums of ``counts``.

    Runs are found in each stretch of time and merged across borders, where only
    one row a run is left.
    """
    counts = counts or {}
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(*keys, F.col(ts).alias("__ts"), micros.alias("__at"), *(c.cast("long").alias(n) for n, c in counts.items()))
    rows = rows.withColumn("__stretch", F.floor(F.col("__at") / (stretch_days * 86_400_000_000)))

    def islands(frame: DataFrame, part: list[str], start: str, end: str) -> DataFrame:
        order = Window.partitionBy(*part).orderBy(start)
        gap = F.col(start) - F.lag(end).over(order)
        joined = (gap <= step_seconds * 1_000_000) if at_most else (gap == step_seconds * 1_000_000)
        flagged = frame.withColumn("__new", F.when(gap.isNull() | ~joined, 1).otherwise(0))
        return flagged.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    sums = [F.sum(n).alias(n) for n in counts]
    local = islands(rows, [*keys, "__stretch"], "__at", "__at").groupBy(*keys, "__stretch", "__run").agg(
        F.min("__ts").alias("start_ts"), F.max("__ts").alias("end_ts"), F.min("__at").alias("__a"), F.max("__at").alias("__b"), F.count(F.lit(1)).alias("n_rows"), *sums
    )
    merged = islands(local.drop("__run", "__stretch"), keys, "__a", "__b").groupBy(*keys, "__run")
    return merged.agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_rows").alias("n_rows"), *sums).drop("__run")


def longest_episode(found: DataFrame, keys: list[str]) -> DataFrame:
    """The episode with most rows, the earliest of equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n_rows"), "start_ts")
    return found.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def separate_segments(df: DataFrame, keys: list[str], position: str, total: str, n: int, before: int, after: int) -> DataFrame:
    """Greedy choice of event rows whose segments do not overlap: event_at, start_at, end_at.

    Every choice depends on the one before it: ``n`` rounds, each a partial
    minimum over the events that fit after the last chosen segment. ``total`` is
    the number of rows of the key. No task holds more than ``n`` choices of a key.
    """
    start, end = F.greatest(F.lit(0), F.col(position) - before), F.least(F.col(total), F.col(position) + after + 1)
    events = df.select(*keys, F.struct(F.col(position).cast("long").alias("event_at"), start.cast("long").alias("start_at"), end.cast("long").alias("end_at")).alias("__event"))
    events = events.where((F.col("__event.end_at") - F.col("__event.start_at")) >= (before + after) // 2)
    state = events.groupBy(*keys).agg(F.array(F.min("__event")).alias("__picked"))
    for _ in range(n - 1):
        fits = F.col("__event.start_at") >= F.element_at("__picked", -1)["end_at"]
        state = events.join(state, keys).groupBy(*keys).agg(F.min(F.when(fits, F.col("__event"))).alias("__next"), F.any_value("__picked").alias("__picked"))
        state = state.select(*keys, F.when(F.col("__next").isNull(), F.col("__picked")).otherwise(F.concat("__picked", F.array("__next"))).alias("__picked"))
    return state.select(*keys, F.explode("__picked").alias("s")).select(*keys, "s.*")


def widest_segment(df: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """start_at and end_at of the stretch of ``length`` rows with the largest population deviation, tried every length // 5 rows; the earliest of equals."""
    step = max(1, length // 5)
    ranged = with_neighbours(positions(in_ranges(df.select(*dict.fromkeys([*keys, *order, value])), keys, order), "start_at", "n"), after=length - 1)
    rows = own_rows(ranged, ranged.frame.withColumn("deviation", F.stddev_pop(value).over(ranged.window().rowsBetween(0, length - 1))))
    rows = rows.select(*keys, (F.col("start_at") - 1).alias("start_at"), "deviation", "n")
    tried = rows.where(((F.col("n") > length) & (F.col("start_at") % step == 0) & (F.col("start_at") <= F.col("n") - length)) | ((F.col("n") <= length) & (F.col("start_at") == 0)))
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("deviation", 9)), "start_at")
    chosen = tried.withColumn("__rank", F.row_number().over(best)).where("__rank = 1")
    return chosen.select(*keys, F.col("start_at").cast("long").alias("start_at"), F.least(F.col("n"), F.col("start_at") + length).cast("long").alias("end_at"))


def neighbourhood(df: DataFrame, keys: list[str], order: list[str], centre: int, radius: int) -> DataFrame:
    """Rows at the positions [centre - radius, centre + radius)."""
    rows = df.withColumn("position", F.row_number().over(_by(keys, order))).where(F.col("position") <= centre + radius)  # a limit that tasks apply before they shuffle
    return rows.withColumn("position", F.col("position") - 1).where(F.col("position") >= max(0, centre - radius))


def rolling_expansion(df: DataFrame, keys: list[str], order: list[str], score: str, is_test: str, window: int = 256, alpha: float = 0.05) -> DataFrame:
    """Causal conformal expansion of each test row: the rank ceil((n + 1)(1 - alpha)) of the last ``window`` scores before it.

    Calibration rows stand before test rows in ``order``. With too short a
    history for the rank, the expansion is NULL.
    """
    ranged = with_neighbours(in_ranges(df, keys, order), before=window)
    past = F.array_sort(F.collect_list(score).over(ranged.window().rowsBetween(-window, -1)))
    rank = F.ceil((F.size("__past") + 1) * F.lit(1 - alpha)).cast("int")
    rows = own_rows(ranged, ranged.frame.withColumn("__past", past)).where(F.col(is_test))
    return rows.withColumn("expansion", F.when((rank <= F.size("__past")) & (F.size("__past") > 0), F.get("__past", rank - 1))).drop("__past")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows at evenly spaced positions, the first and the last included."""
    rows = positions(in_ranges(df, keys, order)).frame.drop(RANGE).withColumn("__at", F.col("__at") - 1)
    # position p is chosen if some i in [0, cap) has floor(i * (n - 1) / (cap - 1)) = p
    step = (F.col("__n") - 1) / F.lit(max(1, cap - 1))
    i = F.ceil(F.col("__at") / step)
    hit = (F.floor(i * step + F.lit(1e-9)) == F.col("__at")) & (i < cap)
    return rows.where((F.col("__n") <= cap) | hit | ((F.lit(cap) == 1) & (F.col("__at") == 0))).drop("__at", "__n")


def evenly_timed(df: DataFrame, keys: list[str], ts: str, quota: str) -> DataFrame:
    """The ``quota`` rows of each key nearest to evenly spaced times; the earlier of equally near ones.

    A row is chosen once, so each choice depends on the one before it. As the
    distance to a time falls and then rises along a key, the choice is the row
    nearest to it, moved behind the last choice and before the rows that later
    times need: only those numbers, at most ``quota`` of a key, are folded. Rows
    are numbered by ranges, and a task tells only the first and the last of its
    rows between two of the wanted times.
    """
    tick = F.unix_micros(F.col(ts).cast("timestamp")) * 1000
    ranged = positions(in_ranges(df.withColumn("__tick", tick), keys, ["__tick", *(c for c in df.columns if c not in (*keys, ts))]))
    rows = over_keys(ranged, {"__low": (F.min, "__tick"), "__high": (F.max, "__tick")}).frame.withColumn("__at", F.col("__at") - 1)
    rows = rows.withColumn("__first", F.min("__at").over(Window.partitionBy(*keys, RANGE, "__tick"))).withColumn("__w", F.col(quota).cast("int"))
    many = rows.where("__n > __w AND __w > 0")
    # the number of wanted times before a row, low + (high - low) * j DIV (w - 1) being time j
    since, span = "CAST(__tick - __low AS DECIMAL(20, 0))", "(__high - __low)"
    passed = F.expr(f"CASE WHEN {span} = 0 THEN 0 WHEN __w = 1 THEN CAST(__tick - __low > {span} DIV 2 AS INT) ELSE CAST(({since} * (__w - 1) + {span} - 1) DIV {span} AS INT) END")
    place = F.struct("__tick", "__first")
    cells = many.where("__tick IS NOT NULL").groupBy(*keys, passed.alias("__j")).agg(
        F.min(place).alias("__from"), F.max(place).alias("__to"), *(F.max(c).alias(c) for c in ("__low", "__high", "__w"))
    )
    of_key = cells.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("__low", "__high", "__w")))
    grid = of_key.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__w"))))
    grid = joined_cells(grid, cells.select(*keys, "__j", "__from", "__to"), [*keys, "__j"], "left")
    number = Window.partitionBy(*keys)
    before, after = number.orderBy("__j").rowsBetween(Window.unboundedPreceding, 0), number.orderBy(F.desc("__j")).rowsBetween(Window.unboundedPreceding, -1)
    aim = F.col("__low") + F.expr(f"CASE WHEN __w = 1 THEN {span} DIV 2 ELSE (CAST({span} AS DECIMAL(20, 0)) * __j) DIV (__w - 1) END")
    near = grid.withColumns({"__b": F.max("__to").over(before), "__a": F.min("__from").over(after), "__aim": aim}).where("__j < __w")
    near = near.select(*keys, "__j", F.when(F.col("__a").isNull() | (F.col("__aim") - F.col("__b.__tick") <= F.col("__a.__tick") - F.col("__aim")), F.col("__b.__first")).otherwise(F.col("__a.__first")).alias("__near"))
    last = many.where("__at >= __n - __w").select(*keys, (F.col("__at") - (F.col("__n") - F.col("__w"))).cast("int").alias("__j"), "__at", "__first")
    wanted = joined_cells(near, last, [*keys, "__j"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__j", "__near", "__at", "__first"))).alias("__aims"))
    picked = F.expr(
        """aggregate(__aims, CAST(array() AS array<bigint>), (done, x) -> concat(done, array(CAST(CASE
            WHEN x.__near <= coalesce(try_element_at(done, -1), -1) THEN try_element_at(done, -1) + 1
            WHEN x.__near > x.__at THEN greatest(coalesce(try_element_at(done, -1), -1) + 1, x.__first)
            ELSE x.__near END AS bigint))))"""
    )
    chosen = wanted.select(*keys, F.explode(picked).alias("__at")).withColumn("__hit", F.lit(True))
    return joined_cells(rows, chosen, [*keys, "__at"], "left").where("__n <= __w OR __hit").select(df.columns)


def head(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("__at", F.row_number().over(_by(keys, order))).where(F.col("__at") <= n).drop("__at")


def positional_split(df: DataFrame, keys: list[str], order: list[str | Column], ratio: float, least: int = 1, name: str = "part", by: Column | None = None) -> DataFrame:
    """First int(n * ratio) rows are train, at least ``least``; half of the rows where even that leaves no test row.

    ``by`` is a number that orders rows as ``order`` does, where its first is none.
    """
    rows = positions(in_ranges(df, keys, order, by)).frame.drop(RANGE)
    cut = F.greatest(F.floor(F.col("__n") * ratio), F.lit(least))
    cut = F.when(cut >= F.col("__n"), F.greatest(F.lit(1), F.floor(F.col("__n") / 2))).otherwise(cut)
    return rows.withColumn(name, F.when(F.col("__at") <= cut, "train").otherwise("test")).drop("__at", "__n")


def hashed_order(id_column: str, seed: int) -> list[Column]:
    """A shuffled order that depends on ids and the seed only."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string"))), F.col(id_column)]


def hashed_number(id_column: str, seed: int) -> Column:
    """A number that orders rows as :func:`hashed_order` does, but for ties."""
    return F.conv(F.substring(hashed_order(id_column, seed)[0], 1, 12), 16, 10).cast("double")


def label_budgets(df: DataFrame, keys: list[str], id_column: str, seed: int, budgets: list[int]) -> DataFrame:
    """Nested label sets: a row is in every budget that is at least its shuffled rank."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*hashed_order(id_column, seed))))
    ranked = ranked.where(F.col("__rank") <= max(budgets))  # a limit that tasks apply before they shuffle
    return ranked.select("*", F.explode(F.array([F.lit(b) for b in budgets])).alias("budget")).where("__rank <= budget").drop("__rank")


def rows_of_windows(df: DataFrame, keys: list[str], order: list[str], is_target: str, width: int) -> DataFrame:
    """The rows that stand in the lag window of a wanted target: only these may feed fitted statistics."""
    ranged = with_neighbours(in_ranges(df, keys, order), after=width)
    used = F.max(F.col(is_target).cast("int")).over(ranged.window().rowsBetween(1, width))
    return own_rows(ranged, ranged.frame.withColumn("__used", used)).where("__used = 1").drop("__used")
