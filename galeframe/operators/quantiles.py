"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The sketch places a value within one rank in so many.
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float] | tuple[str, float, str]], few_groups: bool = True) -> DataFrame:
    """The keys and, by name, the percentile of a column (column, share) with linear interpolation.

    Between equal values it is that value to the last bit, so that rows compare
    with it as with themselves. Between two values a bit apart, interpolation can
    only round to one of them: which rows lie above a percentile is told by the
    value on its lower side, and which lie below it by the one on its upper side,
    asked for as (column, share, "floor") and (column, share, "ceil"). Missing values count for nothing; a group without
    values has NULL. One pass
    draws a mergeable sketch of each group, which brackets every percentile from
    both sides. A second one counts, by task, how many rows lie where with respect
    to all brackets at once, and keeps the counted values inside, a few of 10,000
    rows. Only those are sorted, so no group is held in one buffer. A bracket that
    misses its rank, which the sketch's bound rules out, is an error. Nothing runs
    and nothing is kept before the result is read.

    The brackets, a row a group, are broadcast: a join that shuffles by the group
    sorts all its rows in one task. With millions of groups, which are small then,
    turn ``few_groups`` off.
    """
    columns = list(dict.fromkeys(c for c, *_ in wanted.values()))
    names, of = list(wanted), [columns.index(c) for c, *_ in wanted.values()]
    shares = [float(share) for _, share, *_ in wanted.values()]
    margin = 3 / ACCURACY
    rows = df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)))
    by = [f"__k{i}" for i in range(len(keys))]
    sketches, zones, inside = [], {}, []
    for i in range(len(columns)):
        mine = [k for k in range(len(names)) if of[k] == i]
        ends = ", ".join(f"{min(1.0, max(0.0, shares[k] + side * margin))!r}D" for k in mine for side in (-1, 1))
        sketches += [F.expr(f"percentile_approx(__v{i}, array({ends}), {ACCURACY})").alias(f"__e{i}"), F.expr(f"count(__v{i})").alias(f"__n{i}")]
        for at, k in enumerate(mine):
            # missing values stay as a count in their own zone, so that every group has a row
            zones[f"__z{k}"] = F.expr(f"CAST(CASE WHEN __v{i} IS NULL THEN 2 WHEN __v{i} < get(__e{i}, {2 * at}) THEN -1 WHEN __v{i} > get(__e{i}, {2 * at + 1}) THEN 1 ELSE 0 END AS tinyint)")
        inside.append(F.expr(f"CASE WHEN {' OR '.join(f'__z{k} = 0' for k in mine)} THEN __v{i} END").alias(f"__in{i}"))
    brackets = rows.groupBy(*by).agg(*sketches).withColumnsRenamed({k: f"{k}b" for k in by})  # a row a group
    if keys:
        placed = rows.join(F.broadcast(brackets) if few_groups else brackets, F.expr(" AND ".join(f"{k} <=> {k}b" for k in by)))
    else:
        placed = rows.crossJoin(F.broadcast(brackets))  # one row
    counts = [F.count(F.lit(1)).alias("n")]
    for i in range(len(columns)):
        counts += [F.min(f"__v{i}").alias(f"__least{i}"), F.max(f"__v{i}").alias(f"__most{i}"), F.max(f"__n{i}").alias(f"__total{i}")]
    cells = placed.withColumns(zones).groupBy(*by, *zones, *inside).agg(*counts)
    each = [
        f"named_struct('which', {k}, 'zone', __z{k}, 'at', CASE WHEN __z{k} = 0 THEN __in{of[k]} END, 'n', n, 'least', __least{of[k]}, 'most', __most{of[k]}, 'total', __total{of[k]}, 'place', {shares[k]!r}D * (__total{of[k]} - 1))"
        for k in range(len(names))
    ]
    cells = cells.select(*by, F.expr(f"explode(array({', '.join(each)}))").alias("c")).select(*by, "c.*")
    counted = cells.groupBy(*by, "which", "zone", "place", "at").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("total").alias("total"))
    up = F.sum("n").over(Window.partitionBy(*by, "which").orderBy("zone", "at").rowsBetween(Window.unboundedPreceding, 0))
    # of a zone outside the bracket only the value next to it has a known rank
    value = "CASE WHEN zone = 0 OR zone = -1 AND {r} = up - 1 THEN most WHEN zone = 1 AND {r} = up - n THEN least END"
    hit = "CASE WHEN up - n <= {r} AND {r} < up THEN " + value + " END"
    ranked = counted.withColumn("up", up).select(*by, "which", "place", "total", *(F.expr(hit.format(r=f"{side}(place)")).alias(side) for side in ("floor", "ceil")))
    ends = [F.expr(f"max(CASE WHEN which = {k} THEN struct(total, place) END)").alias(f"of{k}") for k in range(len(names))]
    ends += [F.expr(f"max(CASE WHEN which = {k} THEN `{side}` END)").alias(f"{side}{k}") for k in range(len(names)) for side in ("floor", "ceil")]
    found = ranked.groupBy(*by).agg(*ends)
    between = "WHEN floor{k} = ceil{k} THEN floor{k} ELSE floor{k} + (of{k}.place - floor(of{k}.place)) * (ceil{k} - floor{k})"
    told = "CASE WHEN of{k}.total > 0 AND (floor{k} IS NULL OR ceil{k} IS NULL) THEN raise_error('a bracket misses its rank') {value} END"
    values = [f"ELSE {side[0]}{k}" if side else between.format(k=k) for k, (_, _, *side) in enumerate(wanted.values())]
    return found.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)), *(F.expr(told.format(k=k, value=values[k])).alias(name) for k, name in enumerate(names)))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' columns where the keys are the same, a missing key being the same as a missing key."""
    other = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(other, met).drop(*(f"__r_{k}" for k in keys))
