"""Ordered work on keys of any size.

A window over a whole key is one sorted partition, however large the key is. Here
the rows are dealt to ranges of the order, cut at quantiles of all rows, so no
(key, range) holds more than its share of them. What a range needs from the
others goes by a small table: running totals start from the totals of the ranges
before, and rows near a border are also dealt to the range that looks across it.

Rows that tie in the value that is cut stay in one range; where many do, collapse
them first, as the operators on values do.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of a range, all keys together, and ranges at most.
ROWS_PER_RANGE = 1 << 18
MOST_RANGES = 4096
RANGE, OWN = "__range", "__own"


@dataclass
class Ranged:
    """Rows with their range, the keys and the order within them."""

    frame: DataFrame
    keys: list[str]
    order: list[str]
    many: bool

    def window(self) -> Window:
        """The rows of a key in their order, within a range."""
        return Window.partitionBy(*self.keys, RANGE).orderBy(*self.order)


def as_number(df: DataFrame, by: str | Column) -> Column:
    """A number that orders rows as ``by`` does; ties may be added."""
    column = F.col(by) if isinstance(by, str) else by
    kind = df.select(column.alias("c")).schema["c"].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        column = F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        column = F.unix_date(column)
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"no ranges of {kind.simpleString()}: give a number that orders the rows")
    return column.cast("double")


def in_ranges(df: DataFrame, keys: list[str], order: list[str], by: str | Column | None = None) -> Ranged:
    """``df`` dealt to ranges of ``by``, by default the first of ``order``.

    Costs a count and, where there is more than one range, one pass for the
    quantiles; a quantile sketch is merged from the tasks. NULLs are a range of
    their own before all others, as they sort first.
    """
    value = as_number(df, order[0] if by is None else by)
    wanted = min(MOST_RANGES, math.ceil(df.count() / ROWS_PER_RANGE))
    cuts: list[float] = []
    if wanted > 1:
        shares = ", ".join(f"{k / wanted!r}D" for k in range(1, wanted))
        found = df.select(value.alias("v")).agg(F.expr(f"percentile_approx(v, array({shares}), {20 * MOST_RANGES})")).first()[0]
        cuts = sorted({float(c) for c in found or [] if math.isfinite(c)})
    if not cuts:
        return Ranged(df.withColumn(RANGE, F.lit(0)), keys, order, False)
    cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__by", outputCol="__bucket", handleInvalid="keep")
    rows = cutter.transform(df.withColumn("__by", value))
    rows = rows.withColumn(RANGE, F.when(F.col("__by").isNull(), -1).otherwise(F.col("__bucket").cast("int"))).drop("__by", "__bucket")
    return Ranged(rows, keys, order, True)


def joined_cells(rows: DataFrame, cells: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``cells``; NULL keys meet NULL keys."""
    other = cells.select(*(F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in cells.columns))
    same = [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]
    return rows.join(other, same, how).drop(*(f"__on_{c}" for c in on))


def running(ranged: Ranged, sums: dict[str, Column]) -> Ranged:
    """Adds ``<name>`` for each of the sums, up to and with the row, and ``<name>_all``, of its key."""
    up_to_here = ranged.window().rowsBetween(Window.unboundedPreceding, 0)
    if not ranged.many:
        whole = Window.partitionBy(*ranged.keys)
        added = {n: F.sum(c).over(up_to_here) for n, c in sums.items()} | {f"{n}_all": F.sum(c).over(whole) for n, c in sums.items()}
        return Ranged(ranged.frame.withColumns(added), ranged.keys, ranged.order, False)
    cells = ranged.frame.groupBy(*ranged.keys, RANGE).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    of_key = Window.partitionBy(*ranged.keys)
    before = of_key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    told = [F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}_before") for n in sums] + [F.sum(f"__{n}").over(of_key).alias(f"{n}_all") for n in sums]
    cells = cells.select(*ranged.keys, RANGE, *told)
    rows = ranged.frame.withColumns({n: F.sum(c).over(up_to_here) for n, c in sums.items()})
    rows = joined_cells(rows, cells, [*ranged.keys, RANGE])
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"__{n}_before") for n in sums}).drop(*(f"__{n}_before" for n in sums))
    return Ranged(rows, ranged.keys, ranged.order, True)


def positions(ranged: Ranged, name: str = "__at", total: str = "__n") -> Ranged:
    """Adds the row's number within its key, from 1, and the number of rows of the key."""
    if not ranged.many:
        return Ranged(ranged.frame.withColumns({name: F.row_number().over(ranged.window()), total: F.count(F.lit(1)).over(Window.partitionBy(*ranged.keys))}), ranged.keys, ranged.order, False)
    cells = ranged.frame.groupBy(*ranged.keys, RANGE).agg(F.count(F.lit(1)).alias("__rows"))
    of_key = Window.partitionBy(*ranged.keys)
    before = F.coalesce(F.sum("__rows").over(of_key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*ranged.keys, RANGE, before.alias("__before"), F.sum("__rows").over(of_key).alias(total))
    rows = joined_cells(ranged.frame.withColumn(name, F.row_number().over(ranged.window())), cells, [*ranged.keys, RANGE])
    return Ranged(rows.withColumn(name, F.col(name) + F.col("__before")).drop("__before"), ranged.keys, ranged.order, True)


def over_keys(ranged: Ranged, wanted: dict[str, tuple[Callable, str]]) -> Ranged:
    """Adds by name the least or largest value of a column, (F.min or F.max, column), over all rows of the key."""
    of_key = Window.partitionBy(*ranged.keys)
    if not ranged.many:
        return Ranged(ranged.frame.withColumns({n: f(c).over(of_key) for n, (f, c) in wanted.items()}), ranged.keys, ranged.order, False)
    cells = ranged.frame.groupBy(*ranged.keys, RANGE).agg(*(f(c).alias(f"__{n}") for n, (f, c) in wanted.items()))
    cells = cells.select(*ranged.keys, RANGE, *(f(f"__{n}").over(of_key).alias(n) for n, (f, _) in wanted.items()))
    return Ranged(joined_cells(ranged.frame, cells, [*ranged.keys, RANGE]), ranged.keys, ranged.order, True)


def with_neighbours(ranged: Ranged, before: int = 0, after: int = 0) -> Ranged:
    """Adds to each range the last ``before`` rows of its key before it and the first ``after`` behind it, marked by ``__own`` being false.

    Only ``before`` (``after``) rows of a range leave it, however many ranges
    they have to be taken from.
    """
    out = ranged.frame.withColumn(OWN, F.lit(True))
    if ranged.many:
        for n, backward in ((before, True), (after, False)):
            if n:
                out = out.unionByName(_dealt_over_borders(ranged, n, backward))
    return Ranged(out, ranged.keys, ranged.order, ranged.many)


def _dealt_over_borders(ranged: Ranged, n: int, backward: bool) -> DataFrame:
    keys, order = ranged.keys, ranged.order
    of_range = Window.partitionBy(*keys, RANGE).orderBy(*(F.desc(c) if backward else F.asc(c) for c in order))
    near = ranged.frame.withColumn("__near", F.row_number().over(of_range)).where(F.col("__near") <= n).drop("__near")
    near = near.withColumn("__no", F.row_number().over(Window.partitionBy(*keys).orderBy(RANGE, *order)))
    # every range has its rows next to the border in ``near``, so the n rows across it stand together there
    if backward:
        wanted = F.sequence(F.greatest(F.min("__no") - n, F.lit(0)), F.min("__no") - 1)
    else:
        wanted = F.sequence(F.max("__no") + 1, F.max("__no") + n)
    cells = near.groupBy(*keys, RANGE).agg(wanted.alias("__no")).select(*keys, F.col(RANGE).alias("__to"), F.explode("__no").alias("__no"))
    dealt = joined_cells(near, cells, [*keys, "__no"])
    return dealt.withColumn(RANGE, F.col("__to")).withColumn(OWN, F.lit(False)).drop("__to", "__no")


def own_rows(ranged: Ranged, frame: DataFrame) -> DataFrame:
    """The rows that stand in their own range, without what was added here."""
    return frame.where(OWN).drop(RANGE, OWN)
